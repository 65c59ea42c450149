"""Token alignment against plain loops over characters of bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from actfold.llm import alignment

PIECES = ["the", " quick", "ing", "é", "ö", "ﬁ", "½", "漢字", "🙂", "\n", "\n\n", " ", "  ", "   \n ", "\t", "\r\n", "\xa0", "　", "\x85", "\x1c", "\x00", "▁", "<s>", "<|endoftext|>", "<0x41>", "()", "');\r", "don't", "1234", "--", "_a", "x" * 30, "é"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_tokenizers()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def entry_bytes(letters, text):
    return bytes(letters[c] for c in text)


def brute(tokenizers, texts):
    """Rows of the contract, from tokens and offsets one by one."""
    a, b = tokenizers
    letters, found = {}, []
    n = 0
    for x in range(256):  # printable bytes stand for themselves, the others from U+0100 on
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            letters[chr(x)] = x
        else:
            letters[chr(256 + n)], n = x, n + 1
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        ta = [(i, entry_bytes(letters, a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            found.append(None)
            continue
        ends = [{sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))} for t in (ta, tb)]
        groups, at = [], 0
        for cut in sorted(ends[0] & ends[1]):
            part = []
            for t in (ta, tb):
                pos, ids = 0, []
                for i, x in t:
                    if at <= pos < cut:
                        ids.append(i)
                    pos += len(x)
                part.append(ids)
            groups.append(part)
            at = cut
        found.append((len(ta), len(tb), groups))
    count = Counter(p for f in found if f for p in {(x, y) for ga, gb in f[2] for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in f[2])
        out.append((f[0], f[1], len(f[2]), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


def test_texts_of_any_kind_equal_loops(spark, tokenizers):
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "a ", "  a", "naïve café", *PIECES]
    texts += ["".join(rng.choice([*PIECES, " ", "word", "Then", ","]) for _ in range(rng.randint(1, 14))) for _ in range(160)]
    texts += texts[100:130]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, pair string, DOC_ID long").repartition(3)
    got = alignment.align(df, block_chars=600)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(tokenizers, texts)
    assert sum(w[0] > 0 for w in want) > 120 and sum(w[0] == 0 for w in want) > 10
    assert rows(got) == want


def test_whole_table_equals_loops(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 1500")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert rows(alignment.align(docs)) == brute(tokenizers, texts)


def test_repeated_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    got = alignment.align(df).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in got) == [(False, 2, 6), (False, 2, 6), (True, 0, 0), (True, 2, 6)]
    assert alignment.align(df.limit(0)).collect() == []
    assert [r.n_a for r in alignment.align(df.where("text is null")).collect()] == [0]


def test_a_wide_group_is_counted_before_it_is_paired():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    ga, gb = np.sort(rng.integers(0, 3, 300)), np.sort(rng.integers(0, 3, 200))
    at, pair, times = alignment.link_pairs(a, b, ga, gb, 3)
    got = Counter()
    for g, p, t in zip(at.tolist(), pair.tolist(), times.tolist(), strict=True):
        got[g, p >> 32, p & 0xFFFFFFFF] += t
    assert got == Counter((g, x, y) for x, g in zip(a.tolist(), ga.tolist(), strict=True) for y, h in zip(b.tolist(), gb.tolist(), strict=True) if g == h)


def test_long_texts_take_linear_time_and_equal_loops(tokenizers):
    aligner = alignment.Aligner(*alignment.default_tokenizers())
    text = "ab漢" * 200_000 + " end"
    (row,) = zip(*(aligner.block([text])[n] for n in alignment.COUNTS), strict=True)
    assert row[0] == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids) and row[1] == len(tokenizers[1].encode(text))
    assert 0 < row[2] <= row[1]


def test_packed_numbers_come_back():
    for x in ([], [1, 2, 3], [-5, 1 << 40]):
        assert alignment.unpacked(alignment.packed(np.array(x, dtype=np.int64))).tolist() == x
