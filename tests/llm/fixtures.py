"""Small document tables for the edge cases, and whole small test tables."""

from pathlib import Path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, length int, spans int"

LINE = "a line of text that is long enough to be judged as a line"
EDGES = [
    (1, f"{LINE}\nshort\n{LINE}"), (2, f"  {LINE.upper()}\t"), (3, LINE), (4, f"x\n{LINE}"), (5, LINE), (5, LINE), (None, LINE),
    (6, None), (7, ""), (8, "   \n\t "), (9, "çé ü ñ " * 40), (10, "word " * 30000), (11, "7" * 30000), (12, "a" * 30000 + "@" + "b.c" * 3000),
    (13, "mail me: first.last@example.org, call +49 (30) 1234-5678 or pay 4111 1111 1111 1111 from 10.0.0.255 not 1.2.3.256"),
    (14, "iban DE89 3704 0044 0532 0130 00; phone 030 1234 5678; 5.6.7.8.9.10.11.12; a@b.c_d@e.f; 0000001.2.3.4"),
    (15, "one two three four five one two three four five six one two three four five"), (16, "é@b.c " * 50 + "😀 1.2.3.4"),
    (2**62, "the end of <|endoftext|> text"), (-3, LINE + "\n" + LINE),
]


def edges(spark):
    """Nulls, empty and long texts, repeats, ties, and columns with clashing names."""
    return spark.createDataFrame([(i, t, None, None, None, "p", 3, 1) for i, t in EDGES], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def written(df, tmp_path: Path, name: str) -> str:
    df.coalesce(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def canon(rows):
    """Rows in an order of their own, nulls included."""
    return sorted((tuple(r) for r in rows), key=repr)
