"""Python string semantics reproduced by the Spark expressions, on random text
(whitespace of every kind, letters and digits of several scripts, punctuation),
plus whole-pipeline invariants on the smallest driver tables."""

import random

from pyspark.sql import functions as F

from fleetlake.functions.text import keep_alnum, py_split_join, py_strip

ALPHABET = (list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　")
            + list("aZé߀½²Ⅷ一٣-/.,_#") + ["​", "́"])


def test_strip_split_alnum_match_python(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["s"], r["j"], r["a"]) for r in df.select(
        "i", py_strip(F.col("t")).alias("s"), py_split_join(F.col("t")).alias("j"),
        keep_alnum(F.col("t")).alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.strip(), " ".join(t.split()), "".join(c for c in t if c.isalnum())), repr(t)


def test_pipeline_invariants(spark):
    from fleetlake.plans import catalog as C
    from fleetlake.plans import kardex as K
    from fleetlake.spec import KARDEX
    sf = "/root/testdata/sf0.001"
    raw = C.raw(spark, sf)
    good, rejected = K.quarantine(raw, KARDEX, C.KEEP)
    assert good.count() + rejected.count() == raw.count()
    # labels do not depend on how the rows are partitioned
    a = sorted(map(tuple, good.select("row_ix", "severity", "component", "fault_category").collect()))
    b = sorted(map(tuple, K.quarantine(raw.repartition(3, "vehicle_id"), KARDEX, C.KEEP)[0]
                   .select("row_ix", "severity", "component", "fault_category").collect()))
    assert a == b


def test_labels_on_raw_text_equal_labels_on_collapsed_text(spark):
    """Keyword tests run on the raw text (multi-word keywords match across any
    white-space run); a plain-Python model on the collapsed text must agree."""
    from fleetlake.functions.keywords import COMPONENT_KEYWORDS, SEVERITY_KEYWORDS, SEVERITY_WEIGHTS
    from fleetlake.operators import labels
    rnd = random.Random(11)
    vocab = sorted({w for ks in COMPONENT_KEYWORDS.values() for k in ks for w in k.split()}
                   | {w for ks in SEVERITY_KEYWORDS.values() for k in ks for w in k.split()}
                   | {"absorber", "slight", "crack", "Not", "WORKING"})
    spaces = [" ", "  ", "\t", "\xa0", "\n ", " "]
    texts = []
    for _ in range(3000):
        n = rnd.randint(0, 8)
        texts.append("".join(rnd.choice(vocab) + rnd.choice(spaces) for _ in range(n)).strip(" "))
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, description string, _desc_raw string")
    df = df.withColumn("description", F.regexp_replace("description", r"\s+", " "))  # any cleaning; labels read _desc_raw
    out = labels.extract_severity(labels.extract_components(df), with_scores=True).collect()
    for r in out:
        t = " ".join(texts[r["i"]].split()).lower()
        comps = sorted(n for n, ks in COMPONENT_KEYWORDS.items() if any(k in t for k in ks))
        assert r["component"] == (", ".join(comps) or None if texts[r["i"]] != "" else None), t
        want = {lv: sum(1 for k in set(ks) if k in t) * SEVERITY_WEIGHTS[lv] for lv, ks in SEVERITY_KEYWORDS.items()}
        assert (r["severity_high"], r["severity_medium"], r["severity_low"]) == (want["high"], want["medium"], want["low"]), t
