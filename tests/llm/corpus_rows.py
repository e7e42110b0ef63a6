"""Rows that every operator must live with."""

from pyspark.sql import types as T

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

#: Rows every operator must live with: NULL and repeated keys and texts, and odd characters.
ODD_ROWS = [
    (3, None), (4, ""), (None, "a text without a key"), (5, " \t\n"), (6, "one"), (7, "same words here"), (7, "same words here"),
    (7, "other words, same key"), (8, "x" * 3000), (9, "é 🎉　 ½ 'twas\r\n<|endoftext|> #$%"), (10, "tie " * 300), (11, "tie " * 300),
]
