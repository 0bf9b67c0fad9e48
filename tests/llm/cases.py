"""Small tables with the rows that break things."""

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
SAME = "The same line of many words stands here so that copies of it can be found by all who look. " * 3

DOCUMENTS = [
    (1, SAME + "first", "en", "b"), (2, SAME + "second", "en", "b"), (3, None, None, None), (4, "", "en", "a"),
    (5, " \t\n\r ", "en", None), (6, LONG, "en", "a"), (7, "one", "fr", "c"), (8, "Äpfel – und \U0001F600 Birnen\n" * 9, "de", "c"),
    (9, SAME + "first", "en", "b"), (None, SAME + "first", None, "b"), (None, None, None, None), (10, "tie", "en", "d"), (10, "tie", "en", "d"),
    (11, "a b\x00c \x1c d\x85e f", "en", "a"),
]
CLASHING = ["size", "bucket", "shard", "_row", "_text", "_hash", "block", "slot", "epoch", "_taken", "_copy", "group", "n_words",
            "component", "node", "first_id", "payload_digest", "host", "template", "_range", "_next", "cell", "_bits", "part"]


def documents(spark, rows=DOCUMENTS):
    """The rows with n_chars and with extra columns whose names the operators use themselves."""
    made = [(i, t, lang, source, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, lang, source in rows]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def pages(spark, rows):
    made = [(*row, *["x"] * len(CLASHING)) for row in rows]
    return spark.createDataFrame(made, "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def saved(df, tmp_path, name):
    """A folder with the frame as the table that queries read."""
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
