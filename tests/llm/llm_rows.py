from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     *[T.StructField(c, T.StringType()) for c in ("cls", "key", "rank", "shard", "words", "tid", "split", "kept_as", "position")]])


def passage(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def hard_rows():
    shared, base = passage(1, 90), passage(2, 150)
    near = base.split()
    near[70] = "changed"
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "xx", "a"), (4, "one two three", "en", "a"), (5, "ONE two\nthree", "en", None),
        (6, base, "en", "a"), (7, base, "en", "b"), (7, base, "en", "b"), (8, " ".join(near), "en", "b"), (9, base.upper(), "en", "b"),
        (10, passage(3, 40) + " " + shared + " " + passage(4, 30), "de", "c"), (11, passage(5, 10) + " " + shared + "x " + passage(6, 50), "de", "c"),
        (12, "the of and\n" * 300, "en", "c"), (13, "a" * 2000, "fr", "c"), (14, passage(7, 20000), "fr", "a"), (None, passage(8, 120), "es", "a"), (None, passage(8, 120), "es", "a"),
        (15, "%%% *** |x| #tag &amp; " * 30, "en", "a"), (16, passage(9, 60) + " </s>[INST] <|im_end|> \\e \\l", "en", "d"),
    ]
    return [(i, t, l, s, None if t is None else len(t), *["clash"] * 9) for i, t, l, s in rows]


