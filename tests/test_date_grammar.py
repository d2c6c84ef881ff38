"""The date grammar against pandas, text by text."""

import random
import warnings
from datetime import datetime

import pandas as pd
from dateutil import parser
from pyspark.sql import functions as F

from fleetlake.functions.dates import parse_datetime

OUT = "yyyy-MM-dd HH:mm:ss"
#: Texts that pandas reads as dates, too: kept out, as bare numbers and times are no dates here.
NO_DATES = ["45291", "123456", "10:30", "2024", "5", "", "  ", "n/a", "abc", "2024-02-30", "31/31/2024", "2024-13-01", "1/2/2024 25:00", "1/2/2024 13:00 PM", "2024-01-01 9", "Foo 5, 2024",
            "2024-01/05", "1-2/2024", "2024-01-05x", "Jan 32, 2024", "2024-01-05 10:61", "9:00 2024-01-05"]


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    return [r[0] for r in rows.orderBy("i").select(F.date_format(parse_datetime("d"), OUT)).collect()]


def test_what_is_no_date(spark):
    assert read(spark, NO_DATES + [None]) == [None] * (len(NO_DATES) + 1)


def test_equals_pandas_and_dateutil(spark):
    rng = random.Random(4)
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    texts = ["2024-01", "2024/01/05", "2024-1-5", "5 Jan 2024", "January 5, 2024", "2024-01-01T09:00:00Z", "2024-01-01T09:00:00.1234567", "1/2/2024 5:06 PM", "01-02-2024", "13-02-2024",
             "2024.3.9", "9.3.2024", "Jan 2024", "03/2024", "20240305", "12/31/2024 12:00 am", "12/31/2024 12:00 PM"]
    for _ in range(600):
        y, m, d = rng.randrange(1980, 2040), rng.randrange(1, 13), rng.randrange(1, 29)
        sep, name = rng.choice("-/."), rng.choice([months[m - 1], months[m - 1][:3], months[m - 1][:3].upper(), months[m - 1].lower()])
        pad = rng.choice(["", "0"])
        num = lambda x: f"{x:0{2 if pad else 1}d}"
        date = rng.choice([f"{y}{sep}{num(m)}{sep}{num(d)}", f"{num(m)}{sep}{num(d)}{sep}{y}", f"{num(d)}{sep}{num(m)}{sep}{y}", f"{y}{m:02d}{d:02d}", f"{name} {d}, {y}", f"{d} {name} {y}", f"{d}-{name}-{y}",
                           f"{d}th {name} {y}", f"{rng.choice(['Mon', 'Friday'])}, {d} {name} {y}"])
        h, mi, s = rng.randrange(24), rng.randrange(60), rng.randrange(60)
        time = rng.choice(["", "", f" {h:02d}:{mi:02d}", f" {h}:{mi:02d}:{s:02d}", f"  {h:02d}:{mi:02d}:{s:02d}.{rng.randrange(10**7)}", f" {h % 12 + 1}:{mi:02d} {rng.choice(['AM', 'pm'])}",
                           f" {h % 12 + 1}:{mi:02d}:{s:02d}{rng.choice(['AM', 'PM'])}", f" {h:02d}:{mi:02d}:{s:02d}{rng.choice(['Z', '+08:00', '-0330', ' UTC'])}"])
        texts.append(f"{rng.choice(['', ' '])}{date}{time}")
    got = read(spark, texts)
    # pandas falls back on dateutil for most shapes, and misreads some times that dateutil reads
    plain = [parser.parse(t.strip(), default=datetime(2024, 1, 1), ignoretz=True).strftime("%Y-%m-%d %H:%M:%S") for t in texts]
    assert not [(t, p, g) for t, p, g in zip(texts, plain, got) if p != g]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        others = [t for t, g in zip(texts, got) if pd.to_datetime(t.strip()).strftime("%Y-%m-%d %H:%M:%S") != g]
    assert len(others) < len(texts) / 50, others


def test_timestamps_and_fractions_stay(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678901' AS t, '2024-01-02 03:04:05.678901' AS s").select(parse_datetime("t").alias("t"), parse_datetime("s").alias("s")).first()
    assert row.t == row.s and row.t.microsecond == 678901
