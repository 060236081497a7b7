from telmora.operators.selectors import Grid

SAMPLES = "labels_fp string, ts_ms long, value double, is_delta boolean"
VECTOR = "labels_fp string, t_ms long, sample_ts_ms long, value double"


def fp(**labels):
    return ",".join(sorted(f'{k}="{v}"' for k, v in labels.items()))


def samples(spark, rows):
    return spark.createDataFrame([(f, t, float(v), False) for f, t, v in rows], SAMPLES)


def vector(spark, rows, t=0):
    return spark.createDataFrame([(f, t, t, float(v)) for f, v in rows], VECTOR)


def values(df):
    """{(labels, t): value}; fails on duplicates."""
    out = {}
    for r in df.collect():
        key = (r["labels_fp"], r["t_ms"])
        assert key not in out, key
        out[key] = r["value"]
    return out


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]["value"]


def at(ms):
    return Grid.instant(ms)
