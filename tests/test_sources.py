"""Files read in parts, JSON arrays, date formats and edges from cell moments, against plain versions."""

import csv
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepspark.functions import dates
from prepspark.operators import bins
from prepspark.sources import files, quoted


@pytest.fixture
def small_splits(spark):
    """Splits of under a thousand bytes, so that quotes, records and cells are cut everywhere."""
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_parts_equal_the_file(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    bits = ["a", "é", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "long word " * 20, '",\n"', "x"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) + "|", rng.choice(["", "y"])) for k in range(250)]
    rows.append((250, "wide\n" * 500 + '"', "y"))  # a cell over many splits
    for part in (0, 1):
        write(tmp_path / f"f{part}.csv", [("id", "text", "flag"), *rows[part::2]], end)
    df = files.scan_csv(spark, str(tmp_path), "id bigint, text string, flag string", parts=True)
    assert quoted.records(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(i, t, f or None) for i, t, f in rows]


def test_parts_with_types_corrupt_rows_and_bad_quotes(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [("n", "name", "at", "ok"), *[(k, f"line\n{k}", f"2024-01-{k % 28 + 1:02d}", k % 2 == 0) for k in range(100)]])
    df = files.scan_csv(spark, str(tmp_path), parts=True)
    assert dict(df.dtypes) == {"n": "int", "name": "string", "at": "date", "ok": "boolean"} and df.count() == 100
    bad = files.scan_csv(spark, str(tmp_path), "n bigint, name bigint, at string, ok string", keep_corrupt=True, parts=True)
    assert bad.where(F.col(files.CORRUPT).isNotNull()).count() == 100
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_csv(spark, str(tmp_path), "n bigint, name bigint, at string, ok string", parts=True).collect()
    (tmp_path / "b.csv").write_text('n,name\n1,"open\n' + "x\n" * 300)
    with pytest.raises(ValueError, match="balance"):
        files.scan_csv(spark, str(tmp_path / "b.csv"), "n bigint, name string", parts=True)


def test_parts_in_latin_1(spark, tmp_path, small_splits):
    (tmp_path / "l.csv").write_bytes("id,t\n".encode() + b"".join(f'{k},"ä\n{k}ß"\n'.encode("latin-1") for k in range(100)))
    got = files.scan_csv_encoding(spark, str(tmp_path), "id bigint, t string", parts=True).collect()
    assert sorted((r.id, r.t) for r in got) == [(k, f"ä\n{k}ß") for k in range(100)]


def test_parts_of_both_encodings_in_few_jobs(spark, tmp_path, small_splits):
    """The number of jobs does not follow that of splits, and either encoding is read by the same scan."""
    want = [(k, f"ä,\n\n{k}\"" + "ß\n" * (700 if k == 5 else 3)) for k in range(60)]
    for name, encoding in (("l.csv", "latin-1"), ("u.csv", "utf-8")):
        with open(tmp_path / name, "w", newline="", encoding=encoding) as f:
            csv.writer(f, lineterminator="\n").writerows([("id", "t"), *want, (" ",)])
    spark.sparkContext.setJobGroup("parts", "parts")
    df = files.scan_csv_encoding(spark, str(tmp_path), "id bigint, t string", parts=True, keep_corrupt=True)
    got = df.collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.id, r.t) for r in got) == sorted(want * 2)
    assert quoted.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8 >= jobs


@pytest.mark.parametrize("seed", range(5))
def test_cut_of_any_splits_and_batches(seed):
    """Splits and batches that end anywhere, held against the text itself; a batch of lines gives few batches of records."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice(['"x\ny"', '"\n\n"', "a", ",", '""', '"\n""\n"']) for _ in range(rng.randrange(6))) for _ in range(400)]
    parts[200] = '"' + "\n" * 300 + '"'
    rows = "\n".join(parts).split("\n")
    borders = sorted({0, *rng.sample(range(len(rows)), 12)})
    found = []
    for a, b in zip(borders, [*borders[1:], len(rows)]):
        odd = [r.count('"') % 2 for r in rows[a:b]]
        found.append(("f", a, sum(odd) % 2 == 1, any(odd)))
    known = {a + 7: ("f", a, owner, True) for (_, a), owner in quoted.split_states(found).items()}
    split = [max(a for a in borders if a <= i) + 7 for i in range(len(rows))]
    cuts = sorted({0, len(rows), *rng.sample(range(len(rows)), 5)})
    batches = [pa.RecordBatch.from_pydict({"split": pa.array(split[a:b], pa.int64()), "line": pa.array([r.encode() for r in rows[a:b]])}) for a, b in zip(cuts, cuts[1:])]
    whole = list(quoted._cut(lambda: known, True)(iter(batches)))
    pieces = pa.Table.from_batches(list(quoted._cut(lambda: known, False)(iter(batches)))).to_pylist()
    got = [r["record"] for b in whole for r in b.to_pylist()]
    for owner in {p["owner"] for p in pieces}:
        got.append(b"\n".join(p["record"] for p in sorted((p for p in pieces if p["owner"] == owner), key=lambda p: p["start"])))
    assert sorted(got) == sorted(p.encode() for p in parts) and len(whole) <= 2 * (len(borders) + len(cuts))
    firsts = [r["record"] for b in whole for r in b.to_pylist() if r["first"]] + [p["record"] for p in pieces if p["first"]]
    assert len(firsts) == 1 and parts[0].encode().startswith(firsts[0])


@pytest.mark.parametrize("found,want", [
    ([("a", 0, False, True), ("a", 9, True, True), ("a", 20, True, True)], [None, None, 9]),
    ([("a", 0, True, True), ("a", 9, False, False), ("a", 20, False, True), ("a", 30, True, True)], [None, 0, 0, 20]),
])
def test_split_states(found, want):
    assert list(quoted.split_states(found).values()) == want


@pytest.mark.parametrize("indent", [None, 2])
def test_results_as_arrays(spark, tmp_path, indent):
    records = [{"run_id": k, "seconds": k / 2, "error": "failed" if k % 3 == 0 else None, "more": {"x": [1, 2]}} for k in range(30)]
    records = [{k: v for k, v in r.items() if v is not None} for r in records]
    (tmp_path / "r1.json").write_text("\n  " + json.dumps(records, indent=indent))
    got = files.scan_run_results(spark, str(tmp_path / "r*.json"), "run_id bigint, seconds double")
    assert sorted(tuple(r) for r in got.collect()) == [(k, k / 2) for k in range(30) if k % 3]
    (tmp_path / "r1.json").write_text(json.dumps(records, indent=indent)[:-40])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_run_results(spark, str(tmp_path / "r*.json"), "run_id bigint, seconds double").collect()


def test_report_as_array(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.concat(F.lit('"é\n'), "id")).repartition(3)
    files.sink_report(df, str(tmp_path / "out"), array=True)
    texts = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")]
    rows = sorted((r["id"], r["s"]) for t in texts for r in json.loads(t))
    assert len(texts) == 3 and rows == [(k, f'"é\n{k}') for k in range(100)]


def test_date_formats(spark):
    rows = [
        ("05/01/2024", "Jan 5, 2024", "20240105", "25/12/2024", "2024-01-05", "5.1.2024 10:30", "Fri, 05 Jan 2024 10:00:00", "1/2/69", "January 5, 2024 3:04 PM"),
        ("12/31/2024", "Feb 15, 2023", "20241231", "05/01/2024", "31/12/2024", "31.12.2023", " ", "12/31/68", "May 1 2020 11:59:59pm"),
        (None, "", "20240230", "1/2/2024 1:02:03", "12/05/2024", None, "1 Mar 2020", "1/1/00", "december 1, 1999"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ("a", "b", "c c", "d", "e", "f", "g", "h", "i")))
    found = dates.find_formats(df, df.columns)
    assert [(f.names, f.whole) for f in found.values()] == [
        (("mdy_slash",), True), (("month_day",), True), (("compact",), False), (("dmy_slash",), True), (("iso", "dmy_slash"), False), (("dmy_dot",), True),
        (("day_month",), True), (("mdy_slash_short",), True), (("full_month_day",), True)]
    got = [[str(v) if v else None for v in r] for r in dates.parse_columns(df, df.columns, found).collect()]
    assert got == [
        ["2024-05-01 00:00:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-12-25 00:00:00", "2024-01-05 00:00:00", "2024-01-05 10:30:00", "2024-01-05 10:00:00", "1969-01-02 00:00:00", "2024-01-05 15:04:00"],
        ["2024-12-31 00:00:00", "2023-02-15 00:00:00", "2024-12-31 00:00:00", "2024-01-05 00:00:00", "2024-12-31 00:00:00", "2023-12-31 00:00:00", None, "2068-12-31 00:00:00", "2020-05-01 23:59:59"],
        [None, None, None, "2024-02-01 01:02:03", "2024-05-12 00:00:00", None, "2020-03-01 00:00:00", "2000-01-01 00:00:00", "1999-12-01 00:00:00"]]
    none = spark.createDataFrame([("x",), (None,)], "t string")
    assert dates.find_formats(none, ["t"])["t"].names == () and [r.t for r in dates.parse_columns(none, ["t"]).collect()] == [None, None]


def lloyd(x, k, rounds=300, tol=1e-4):
    """Edges by whole passes over the values."""
    lo, hi = x.min(), x.max()
    edges = [lo + (hi - lo) * i / k for i in range(k)] + [hi]
    c = np.array([(a + b) / 2 for a, b in zip(edges, edges[1:])])
    for _ in range(rounds):
        at = np.searchsorted((c[1:] + c[:-1]) / 2, x, side="right")
        new = np.sort([x[at == i].mean() if (at == i).any() else c[i] for i in range(k)])
        shift, c = ((new - c) ** 2).sum(), new
        if shift <= tol * x.var():
            break
    return [lo, *((c[1:] + c[:-1]) / 2), hi]


@pytest.mark.parametrize("fetch", [50_000, 3])
def test_kmeans_edges_equal_whole_passes(spark, monkeypatch, fetch):
    monkeypatch.setattr(bins, "FETCH_VALUES", fetch)
    rng = np.random.default_rng(4)
    cols = {"even": rng.random(600) * 100 - 50, "skewed": np.exp(rng.standard_normal(600) * 3), "few": rng.integers(0, 4, 600).astype(float), "same": np.full(600, 7.0)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(600)], ", ".join(f"{c} double" for c in cols))
    got = bins.kmeans_edges(df, list(cols), 4)
    for c in ("even", "skewed", "few"):
        assert np.allclose(got[c], lloyd(cols[c], 4), rtol=1e-9, atol=1e-9), c
    assert got["same"] == [7.0] * 5
