"""actfold: legislative-record and corpus analytics as Spark DataFrame operators."""
