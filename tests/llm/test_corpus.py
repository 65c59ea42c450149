"""Sharding, language ID, quality, packing and mixing on small tables."""

import math
import random
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from actfold.llm import language, mixing, packing, quality, sharding
from actfold.llm.common import Scratch, pick

DOCS = "doc_id long, text string, lang string, source string"


def test_pick_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
    assert pick(df, doc_id="doc_id", text="text").collect() == [(1, "a")]
    with pytest.raises(ValueError):
        pick(df, x="Text")


@pytest.mark.parametrize("keys", ["spread", "hot", "null"])
def test_shards_are_near_equal_and_slots_gapless(spark, keys):
    rng = random.Random(1)
    key = {"spread": lambda i: rng.randint(-(10**15), 10**15), "hot": lambda i: 7 if i % 3 else i, "null": lambda i: None if i % 4 == 0 else i}[keys]
    rows = [(key(i), 10 + int(rng.expovariate(0.01)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard int").repartition(5)
    got = sharding.shard(df.withColumnRenamed("shard", "n"), 12, run_rows=100).collect()
    assert sorted(r.n for r in got) == list(range(3000))
    total, sums = sum(r[1] for r in rows), np.zeros(12)
    for s in range(12):
        part = sorted((r.slot, r.doc_id if r.doc_id is not None else -(1 << 62)) for r in got if r.shard == s)
        assert [p[0] for p in part] == list(range(len(part)))
        assert [p[1] for p in part] == sorted(p[1] for p in part)
        sums[s] = sum(r.size for r in got if r.shard == s)
    assert abs(sums - total / 12).max() <= max(r[1] for r in rows) + 0.01 * total / 12


@pytest.mark.parametrize("key", ["id", "id % 7", "case when id % 3 = 0 then 5 else id * id end", "cast(null as bigint)"])
def test_runs_are_short_and_shards_equal_a_deal_in_order(spark, key):
    slim = Scratch(spark).save(spark.range(0, 60_000, 1, 6).selectExpr(f"coalesce({key}, -9223372036854775808) as key", "id as uid", "id % 50 + 1 as size"), "slim")
    hist = sharding.Histogram(slim)
    cuts = sharding.splitters(hist, 8, 0.002, 500)
    assert max(p[3] for p in hist.parts) <= 500 and sum(p[3] for p in hist.parts) == 60_000
    rows = sorted((sharding._pack(r.key, r.uid), r["size"]) for r in slim.collect())
    total, at, done = sum(n for _, n in rows), 0, 0
    for k, cut in enumerate(cuts, 1):
        while at < len(rows) and rows[at][0] < cut:
            done += rows[at][1]
            at += 1
        assert abs(done - total * k / 8) <= max(50, 0.002 * total / 8)


def test_shards_equal_a_sequential_deal(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 400), rng.randint(1, 9), i) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, size long, n int").coalesce(1), 5, run_rows=64).collect()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.n) for r in order] == sorted((k, i) for k, _, i in rows)
    assert all(abs(sum(r["size"] for r in got if r.shard <= s) - sum(r[1] for r in rows) * (s + 1) / 5) <= 9 for s in range(5))


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5)], "doc_id long, size long")
    assert sharding.shard(df, 40).count() == 2
    assert sharding.shard(df.limit(0), 40).columns == ["doc_id", "size", "shard", "slot"]
    one = spark.createDataFrame([(1, None)], "doc_id long, size long")
    assert sharding.shard(one, 3).first().slot == 0
    rows = sharding.query_rows(spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["size"], r.text_crc32) for r in rows] == [(18, zlib.crc32("é".encode())), (16, 0)]


WORDS = {"en": ["the", "heather", "shing", "ouring", "thanks", "weather"], "fr": ["été", "leaux", "mentre", "voient", "une", "quelle"], "de": ["schön", "keiten", "nicht", "über", "lichte", "zeug"]}


def text_in(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ",", "."]) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rng = random.Random(2)
    rows = [(i, text_in(lang := rng.choice(list(WORDS)), rng), lang, "s") for i in range(300)] + [(1000, None, "en", "s"), (1001, "12 34 !?", "en", "s"), (1002, "", None, "s"), (1003, "x" * 5000, None, "s"), (None, "the", None, "s")]
    df = spark.createDataFrame(rows, DOCS)
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model=model).withColumn("held", language.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) and {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    held = [r for r in got.values() if r.held and r.lang and r.lang_pred != "und"]
    assert len(held) > 60 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values() if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(df.limit(0)) is None
    assert {r.lang_pred for r in language.identify(df, model=None).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    chance = np.array([[0.2], [0.1], [0.3], [0.1], [0.2], [0.1], [language.FLOOR]])

    def brute(w):
        if not w:
            return 1.0
        out = sum(chance[pieces.index(w[:n]), 0] * brute(w[n:]) for n in range(1, len(w) + 1) if w[:n] in pieces)
        return out + (language.FLOOR * brute(w[1:]) if w[0] not in pieces else 0)

    model = language.Model(["x"], language.Vocabulary(pieces), chance)
    words = ["ab", "abba", "aab", "zb", "a"]
    assert np.allclose(model.log_likelihood(words)[:, 0], [np.log(brute("▁" + w)) for w in words])
    rng = random.Random(3)
    long = ["".join(rng.choice("abz") for _ in range(n)) for n in (39, 40, 41, 60, 61, 257, 3, 1000)]
    assert np.allclose(model.log_likelihood(long)[:, 0], [exact("▁" + w, pieces, chance[:, 0]) for w in long])


def exact(word, pieces, chance):
    """The logarithm of the sum over all segmentations, in fractions."""
    forward = [Fraction(1)]
    for j in range(1, len(word) + 1):
        ways = [forward[i] * Fraction(chance[pieces.index(word[i:j])]) for i in range(max(0, j - 2), j) if word[i:j] in pieces]
        forward.append(sum(ways, Fraction(0)) + (forward[-1] * Fraction(language.FLOOR) if word[j - 1] not in pieces else 0))
    return math.log(forward[-1].numerator) - math.log(forward[-1].denominator)


def test_expectation_is_the_brute_force_one(spark):
    pieces, words = ["a", "b", "ab", "▁", "▁a", "ba"], {"abab": 3, "ba": 2}

    def ways(w):
        return [[]] if not w else [[w[:n], *rest] for n in range(1, min(2, len(w)) + 1) if w[:n] in pieces for rest in ways(w[n:])]

    chance = {p: 1 / len(pieces) for p in pieces}
    for step in range(3):
        sums = dict.fromkeys(pieces, 0.0)
        for w, n in words.items():
            if step == 0:
                text = "▁" + w
                for p in pieces:
                    sums[p] += n * sum(text.startswith(p, i) for i in range(len(text)))
                continue
            found = [(math.prod(chance[p] for p in x), x) for x in ways("▁" + w)]
            for c, x in found:
                for p in x:
                    sums[p] += n * c / sum(c for c, _ in found)
        total = sum(sums.values())
        chance = {p: 0.999 * sums[p] / total + 0.001 / len(pieces) for p in pieces}
    rows = [(i, w, "x") for i, w in zip([i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1], [w for w, n in words.items() for _ in range(n)], strict=False)]
    original = language.public_pieces
    try:
        language.public_pieces = lambda path=None: pieces
        model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    finally:
        language.public_pieces = original
    assert np.allclose(model.chance[:-1, 0], [chance[p] for p in pieces])


def test_rare_languages_are_learned(spark):
    rng = random.Random(4)
    rows = [(i, text_in("en", rng), "en") for i in range(400)] + [(400 + i, text_in("fr", rng), "fr") for i in range(12)] + [(900, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, sample_docs=30).langs == ["en", "fr"]


def test_every_label_is_learned(spark):
    rng = random.Random(5)
    made = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4)] for k in range(300)}
    rows = [(i, " ".join(rng.choice(made[lang]) for _ in range(20)), lang) for i, lang in enumerate(x for x in made for _ in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df)
    assert model.langs == sorted(made)
    got = language.identify(df, model=model).withColumn("held", language.held_out(F.col("doc_id"))).where("held").collect()
    assert len(got) > 1000 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_numbers_are_no_letters(spark):
    """No text of characters outside the letter categories has a language, whatever else they are."""
    chars = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i))[0] != "L" and not 0xD800 <= i < 0xE000]
    numbers = [c for c in chars if unicodedata.category(c)[0] == "N"]
    rows = [(i, c) for i, c in enumerate(numbers)] + [(5000 + i, "".join(chars[a : a + 500])) for i, a in enumerate(range(0, len(chars), 500))]
    rows += [(100_000, "½"), (100_001, "² Ⅷ"), (100_002, "①"), (100_003, "the½heather")]
    model = language.fit(spark.createDataFrame([(i, text_in("en", random.Random(i)), "en") for i in range(30)], "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model=model)
    assert [r.doc_id for r in got.where("lang_pred != 'und' or score != 0").collect()] == [100_003]
    assert language.letter_words("the½heather Ⅷ a1b_c é") == ["the", "heather", "a", "b", "c", "é"]


def test_expected_uses_of_long_words_equal_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "aba"]
    chance = np.array([0.2, 0.1, 0.3, 0.1, 0.2, 0.05, 0.05, language.FLOOR])
    vocabulary, rng = language.Vocabulary(pieces), random.Random(2)

    def brute(w):
        """Sums over segmentations in exact fractions, from the left and from the right."""
        f = [Fraction(0)] * (len(w) + 1)
        b = f[:]
        f[0] = b[-1] = Fraction(1)
        of = lambda i, j: Fraction(chance[pieces.index(w[i:j])]) if w[i:j] in pieces else Fraction(language.FLOOR) if j == i + 1 else 0
        spans = [(i, j) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 3) + 1) if of(i, j)]
        for i, j in sorted(spans, key=lambda x: x[1]):
            f[j] += f[i] * of(i, j)
        for i, j in sorted(spans, key=lambda x: -x[0]):
            b[i] += b[j] * of(i, j)
        uses = np.zeros(len(chance))
        for i, j in spans:
            uses[pieces.index(w[i:j]) if w[i:j] in pieces else -1] += float(f[i] * of(i, j) * b[j] / f[-1])
        return uses

    for n in (3, 60, 400):
        words = ["▁" + "".join(rng.choice("abz") for _ in range(n)) for _ in range(4)]
        got = np.zeros((4, len(chance)))
        for r, p, uses in language.expected_uses(list(language._edges(vocabulary, words)), n + 1, 4, lambda r, p: chance[p]):
            np.add.at(got, (r, p), uses)
        assert np.allclose(got, [brute(w) for w in words])


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = text_in("en", rng, 40) if good else "BUY!! NOW!! " * 20
        rows.append((i, text, "p", f"h{i % 5}"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(9000, None, None, None), (9001, text_in("en", rng, 40), "rare", "new")]
    out = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (9999, 1), (1, labels[0][1])], "doc_id long, quality int"), "source", "lang")
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].keep == bool(q) for i, q in labels]) > 0.97
    mean = np.mean([q for _, q in labels])
    assert abs(got[9001].host_post - mean) < 0.02 and got[9001].keep
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality for r in quality.classify(spark.createDataFrame(rows[:5], DOCS), none, "source", "lang").collect()} == {0.5}
    assert quality.classify(spark.createDataFrame([], DOCS), none, "source", "lang").count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, text_in(rng.choice(list(WORDS)), rng, rng.randint(1, 900))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "日本 <|endoftext|> It's ½ ΣΑΣ"), (203, "word " * 9000), (None, "x"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_seq, by_doc = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for i, parts in by_doc.items():
        times = sum(d == i for d, _ in rows)
        cover = np.zeros(len(ids[i]), int)
        for s, n in parts:
            cover[s : s + n] += 1
        assert (cover == times).all()
    total = sum(r.length for r in got)
    assert total > 0.97 * 2048 * len(by_seq)
    assert packing.pack(df.limit(0)).count() == 0


def test_ids_of_every_letter_are_the_tokenizer_s():
    encode = packing.PieceIds(packing.default_tokenizer(), most=4_000)
    plain = lambda t: np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    texts = [f"a{chr(c)}b {chr(c)} x'{chr(c)}s 1{chr(c)}2" for c in range(0x3000)]
    rng, letters = random.Random(5), [chr(c) for c in range(32, 0x250)] + list("\t\n\r '--stredmlv")
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab12 '\n!sdrevtmlé-") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert [t for t, ids in zip(texts, encode(texts), strict=True) if ids != plain(t)] == []


def test_differencing_balances():
    rng = random.Random(5)
    sizes = [rng.randint(1, 500) for _ in range(300)]
    parts = packing.differencing(sizes, 40)
    assert sorted(i for _, m in parts for i in m) == list(range(300))
    assert all(s == sum(sizes[i] for i in m) for s, m in parts)
    assert parts[0][0] - parts[-1][0] < 30
    assert all(sum(n for _, _, n in w) <= 100 for w in packing.windows_of([250, 99, 1, 60, 60], 100, 50))


def test_raking_meets_the_margins(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 50), rng.choice(["en", "fr", None]), rng.choice("abc" if i % 3 else "a")) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    targets = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.4), ("gone", 0.5)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.3), (None, 0.2)], "value string, share double")}
    slim = df.withColumn("tokens", F.size(F.split(F.trim("text"), " ")))
    out = mixing.mix(slim, ["source", "lang"], targets=targets, keep=0.3).cache()
    w = {(r.source, r.lang): r.w for r in out.groupBy("source", "lang").agg(F.first("_weight").alias("w")).collect()}
    total = sum(w.values())
    # The same in numpy.
    cells = {k: 0.0 for k in w}
    for _, t, lang, s in rows:
        cells[s, lang] += len(t.split())
    for _ in range(200):
        for axis, share in ((0, {"a": 0.3, "b": 0.3, "c": 0.4}), (1, {"en": 0.5, "fr": 0.3, None: 0.2})):
            for v, x in share.items():
                now = sum(n for k, n in cells.items() if k[axis] == v)
                for k in cells:
                    if k[axis] == v:
                        cells[k] *= x * total / now
    assert all(abs(cells[k] - w[k]) < 2e-3 * total for k in w)
    tokens = out.agg(F.sum("tokens"), F.sum(F.when(F.col("_kept"), F.col("tokens")))).first()
    assert abs(tokens[1] / tokens[0] - 0.3) < 0.04 and out.first()._error <= 1e-4
    again = mixing.mix(slim.repartition(7), ["source", "lang"], targets=targets, keep=0.3)
    assert {r.doc_id for r in again.where("_kept").collect()} == {r.doc_id for r in out.where("_kept").collect()}
    chance = {r.doc_id: r._probability for r in out.collect()}
    draws = {r.doc_id: r.d for r in out.select("doc_id", mixing.drawn(F.col("doc_id"), 7).alias("d")).collect()}
    assert {r.doc_id for r in out.where("_kept").collect()} == {i for i in chance if draws[i] < chance[i]}
    assert abs(np.mean(list(draws.values())) - 0.5) < 0.03


def test_contradictory_targets_show_their_error(spark):
    slim = spark.createDataFrame([(i, "a" if i % 2 else "b", "x" if i % 2 else "y", 3) for i in range(40)], "doc_id long, source string, lang string, tokens long")
    share = lambda **kw: spark.createDataFrame(list(kw.items()), "value string, share double")
    out = mixing.mix(slim, ["source", "lang"], targets={"source": share(a=0.9, b=0.1), "lang": share(x=0.2, y=0.8)})
    assert out.count() == 40 and out.first()._error > 0.5


def test_topics_part_word_use_within_languages(spark):
    rng = random.Random(9)
    sets = {lang: {t: [f"{lang}{t}{k}" for k in range(12)] for t in "pq"} for lang in ("en", "fr")}
    rows = [(i, " ".join(rng.choice(sets[lang][t]) for _ in range(60)), lang, t) for i, (lang, t) in enumerate((lang, t) for lang in sets for t in "pq" for _ in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, t string")
    got = mixing.with_topics(df, mixing.fit_topics(df, topics=4)).collect()
    for lang in sets:
        seen = {t: {r.topic for r in got if r.lang == lang and r.t == t} for t in "pq"}
        assert not seen["p"] & seen["q"]
    assert all(r.tokens == 60 for r in got)
    assert mixing.fit_topics(df.limit(0)) is None


def test_topics_come_from_all_documents(spark):
    """The means are those of all 6,002 documents, and the deal of the rows changes nothing."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(30)), "en") for i in range(6000)]
    rows += [(6000 + i, "quite other words here", "en") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = mixing.fit_topics(df.repartition(3), topics=2), mixing.fit_topics(df.repartition(5), topics=2)
    assert np.array_equal(one.centres, other.centres) and np.array_equal(one.mean, other.mean)
    units = np.stack([np.rint(mixing.word_counts(t)[1] * mixing.STEPS) for _, t, _ in rows])
    assert np.allclose(one.means["en"], units.mean(axis=0) / mixing.STEPS)  # of a sample it would be another


def test_words_are_counted_once(spark):
    """A text is read once for the fit, the cells and the draw together."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") * 3 for _ in range(20)), "en", f"s{i % 3}") for i in range(120)], DOCS)
    for run in (mixing.mix_documents, mixing.sample_documents):
        seen = spark.sparkContext.accumulator(0)

        def read(text, seen=seen):
            seen.add(1)
            return text

        run(df.withColumn("text", F.udf(read, "string")("text"))).collect()
        assert seen.value == 120


def test_centres_are_those_of_whole_rounds(spark):
    """Only documents that move are summed; the centres are those of a loop that sums all of them each round."""
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(pool[5 * (i % 5) : 5 * (i % 5) + 16]) for _ in range(40)), rng.choice(["en", "fr"])) for i in range(400)]
    rows += [(400, "many " * 300 + "w1", "en"), (401, "most " * 70_000 + "w2", "fr"), (402, "w3", None), (403, " ", "en"), (404, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    units = {i: mixing.word_counts(t)[1] for i, t, _ in rows}
    x = {i: np.rint(u * mixing.STEPS) / mixing.STEPS for i, u in units.items() if u is not None}
    for rounds in (1, 2, 25):
        found = mixing.fit_topics(df, topics=6, rounds=rounds)
        c = mixing.fit_topics(df, topics=6, rounds=0).centres
        z = np.stack([x[i] - found.means.get(lang, found.mean) for i, _, lang in rows if i in x])
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        for _ in range(rounds):
            own = (z @ c.T).round(9).argmax(axis=1)
            sums = np.stack([np.rint(z[own == k] * mixing.FINE).sum(axis=0) if (own == k).any() else c[k] for k in range(6)])
            c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        assert np.allclose(found.centres, c, atol=1e-9)
    got = {r.doc_id: r for r in mixing.with_topics(df, found).collect()}
    for i, t, lang in rows:
        assert got[i].tokens == len((t or "").split())
        near = None if units[i] is None else found.centres @ (units[i] - found.means.get(lang, found.mean))
        assert got[i].topic == "none" if near is None else near.max() - near[int(got[i].topic[6:])] < 1e-9


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a")], DOCS)
    out = mixing.mix_documents(df, keep=1.0).collect()
    assert len(out) == 5 and {r.doc_id for r in out if r._kept} >= {3}
    assert not any(r._kept for r in out if r.tokens == 0)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_wide_cells_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    df = spark.createDataFrame([(i, "x y", "en", f"s{i % 9}") for i in range(90)], DOCS)
    out = mixing.mix_documents(df, keep=0.5)
    weights = {r.doc_id: r._weight for r in out.collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1000)
    few = mixing.mix_documents(df, keep=0.5).collect()
    assert all(abs(weights[r.doc_id] - r._weight) < 1e-9 * max(1, r._weight) for r in few) and few[0]._error <= 1e-4
    assert out.count() == 90 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_scratch_tables_go_when_dropped(spark):
    work = Scratch(spark)
    t = work.save(spark.range(3), "t")
    assert t.count() == 3
    work.drop(t)
