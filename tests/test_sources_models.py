"""Ingest, run artifacts, streaming, and fitted models."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_operators import audit_frame
from upliftforge.operators import learners
from upliftforge.roles import FEATURES, LABELS, OUTCOME, ROW_ID, TREATMENT, ContractError
from upliftforge.sources import digests, files, ingest
from upliftforge.sources.runs import Run, Store, check_language, promote
from upliftforge.streaming import counts


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def write_csv(spark, base, n=30):
    audit_frame(spark, n).orderBy(ROW_ID).select(*FEATURES, *LABELS).coalesce(1).write.options(header=True).csv(f"{base}/csv")
    return f"{base}/csv"


def test_convert_and_validate(spark, base):
    found = ingest.convert_csv(spark, write_csv(spark, base), f"{base}/p")
    assert found["rows"] == 30
    again = ingest.validate_processed(spark, f"{base}/p", 30, found["digest"])
    assert again == found
    with pytest.raises(ContractError):
        ingest.validate_processed(spark, f"{base}/p", 31)
    with pytest.raises(ContractError):
        ingest.convert_csv(spark, f"{base}/csv", f"{base}/p")
    with pytest.raises(ContractError):
        ingest.convert_csv(spark, f"{base}/csv", f"{base}/q", row_limit=31)
    assert not Store(spark).exists(f"{base}/q")
    with pytest.raises(ContractError):
        ingest.scan(spark, f"{base}/p", ["f0", "other"])
    assert ingest.scan(spark, f"{base}/p", ["f0"]).columns == ["f0"]
    assert len(ingest.to_pandas(ingest.scan(spark, f"{base}/p", ["f0"]), ["f0"], 30)) == 30
    with pytest.raises(ContractError):
        ingest.to_pandas(ingest.scan(spark, f"{base}/p", ["f0"]), ["f0"], 29)


def plain_digest(rows, columns, types, leaf_rows, fan_out):
    """The digests of a table held in memory; a row is a dict."""
    sha, found = lambda t: hashlib.sha256(t.encode()).hexdigest(), {}
    for c, kind in zip(columns, types, strict=True):
        leaves = {}
        for r in sorted(rows, key=lambda r: r[ROW_ID]):
            v = r[c]
            bits = lambda v: str(struct.unpack(">q", struct.pack(">d", v))[0])
            text = "-" if v is None else bits(v) if kind == "double" else sha(v) if kind == "string" else str(v)
            leaves.setdefault(r[ROW_ID] // leaf_rows, []).append(text)
        level, height = {k: sha("\n".join(v)) for k, v in leaves.items()}, 0
        while height < 2 or len(level) > 1 or max(level) > 0:
            up = {}
            for k in sorted(level):
                up.setdefault(k // fan_out, []).append(f"{k}:{level[k]}")
            level, height = {k: sha("\n".join(v)) for k, v in up.items()}, height + 1
        found[c] = (len(rows), sum(r[c] is not None for r in rows), sha(f"{c}\n{kind}\n{level[0]}"))
    return found


def test_digest_matches_a_plain_tree(spark):
    df = audit_frame(spark, 300).withColumn("note", F.when(F.col(ROW_ID) % 3 > 0, F.concat(F.lit("ü-\n"), F.col(ROW_ID))))
    df = df.withColumn("f3", F.when(F.col(ROW_ID) % 5 > 0, F.col("f3") / 7)).where(F.col(ROW_ID) % 50 != 7)
    rows = [r.asDict() for r in df.collect()]
    for leaf_rows, fan_out in ((4, 3), (16, 2), (4096, 256)):
        found = {r.column_name: (r.rows, r.non_missing, r.sha256) for r in digests.semantic_digest(df.repartition(5), leaf_rows=leaf_rows, fan_out=fan_out).collect()}
        assert found == plain_digest(rows, df.columns, [t for _, t in df.dtypes], leaf_rows, fan_out)


def test_digest_ignores_batches_and_sees_values(spark):
    df = audit_frame(spark, 50)
    values = lambda df: sorted(map(tuple, ingest.semantic_digest(df).collect()))
    one = values(df)
    assert one == values(df.repartition(7))
    assert one != values(df.withColumn("f0", F.col("f0") + 1e-9))
    assert one != values(df.withColumnRenamed("f0", "g0")) and one != values(df.withColumn("treatment", F.col("treatment").cast("int")))
    empty = ingest.semantic_digest(df.where("false")).collect()
    assert len(empty) == len(df.columns) and all((r.rows, r.non_missing) == (0, 0) for r in empty)
    for bad in (df.withColumn(ROW_ID, F.lit(None).cast("long")), df.withColumn(ROW_ID, F.col(ROW_ID) - 1)):
        with pytest.raises(ContractError):
            ingest.semantic_digest(bad)
    with pytest.raises(ContractError):
        digests.merkle_tree(df.withColumn(ROW_ID, F.lit(3).cast("long")), leaf_rows=16)


def test_swapped_values_are_found_and_located(spark):
    df = audit_frame(spark, 400).withColumn("f0", F.col(ROW_ID).cast("double"))
    other = F.when(F.col(ROW_ID) == 201, 330).when(F.col(ROW_ID) == 330, 201).otherwise(F.col(ROW_ID)).cast("double")
    swapped = df.withColumn("f0", other).withColumn("f1", F.when(F.col(ROW_ID) != 399, F.col("f1")))
    trees = [digests.merkle_tree(d.repartition(3), leaf_rows=8, fan_out=4) for d in (df, swapped, df.where(F.col(ROW_ID) < 100))]
    found = {r.column_name: (r.first_row, r.last_row) for r in digests.first_difference(trees[0], trees[1], 8, 4).collect()}
    assert found == {"f0": (200, 207), "f1": (392, 399)}
    assert digests.first_difference(trees[0], trees[0], 8, 4).count() == 0
    shorter = digests.first_difference(trees[0], trees[2], 8, 4).collect()
    assert {(r.first_row, r.last_row) for r in shorter} == {(96, 103)} and len(shorter) == len(df.columns)


def test_files_of_any_size_are_hashed(spark, tmp_path):
    (tmp_path / "in a folder").mkdir()
    big, small, empty = tmp_path / "in a folder" / "3 GB.bin", tmp_path / "small.bin", tmp_path / "empty.bin"
    small.write_bytes(b"y")
    empty.write_bytes(b"")  # scans do not list it
    with open(big, "wb") as out:
        out.truncate(3 << 30)
        out.seek(1 << 31)
        out.write(b"x")
    sha, zeros = hashlib.sha256(), bytes(1 << 20)
    for k in range(3 << 10):
        sha.update(b"x" + zeros[1:] if k == 2048 else zeros)
    df = files.file_digests(spark, f"file://{tmp_path}")
    assert {(r.path, r.bytes, r.sha256) for r in df.collect()} == {(str(big), 3 << 30, sha.hexdigest()), (str(small), 1, hashlib.sha256(b"y").hexdigest())}
    assert "ReadSchema: struct<path:string,length:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_other_systems_come_as_values(spark, base, monkeypatch):
    audit_frame(spark, 40).coalesce(2).write.parquet(f"{base}/p")
    streamed = [sorted(map(tuple, f(spark, f"{base}/p").collect())) for f in (files.file_digests, files.row_groups)]
    monkeypatch.setattr(files, "is_readable", lambda path: False)
    assert streamed == [sorted(map(tuple, f(spark, f"{base}/p").collect())) for f in (files.file_digests, files.row_groups)]


def test_safe_cast(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",".join([*FEATURES, *LABELS]) + "\n" + ",".join(["oops", *["1.5"] * 11, "1", "0", "", "1"]) + "\n")
    raw = ingest.read_csv_text(spark, f"file://{tmp_path}/x.csv")
    row = ingest.safe_cast(raw).first()
    assert row.f0 is None and row.f1 == 1.5 and row.visit is None
    with pytest.raises(Exception, match="."):
        ingest.read_csv_typed(spark, f"file://{tmp_path}/x.csv").collect()


def test_selector():
    assert ingest.Selector.load('{"source": "a", "processed": "b"}').rows is None
    for bad in ('{"source": "a"}', '{"source": "a", "processed": "b", "sha256": "xyz"}', '{"source": "a", "processed": "b", "other": 1}', '{"source": "a", "processed": "b", "features": ["f1"]}'):
        with pytest.raises(ContractError):
            ingest.Selector.load(bad)


def test_open_processed_checks_digest(spark, base):
    audit_frame(spark).coalesce(1).write.parquet(f"{base}/p")
    sha = ingest.table_digest(spark, f"{base}/p")
    open_ = lambda **more: ingest.open_processed(spark, ingest.Selector("", f"{base}/p", **{"sha256": sha, **more}))
    assert open_().count() == 20 and open_(rows=20).count() == 20
    for wrong in ({"sha256": "0" * 64}, {"sha256": None}, {"rows": 21}):
        with pytest.raises(ContractError):
            open_(**wrong)
    audit_frame(spark, 5).coalesce(1).write.mode("append").parquet(f"{base}/p")  # the pinned file is there, and another
    with pytest.raises(ContractError):
        open_()
    audit_frame(spark).drop("exposure").coalesce(1).write.parquet(f"{base}/less")
    with pytest.raises(ContractError):
        ingest.open_processed(spark, ingest.Selector("", f"{base}/less", ingest.table_digest(spark, f"{base}/less")))


def test_layout_of_row_groups(spark, base):
    df = audit_frame(spark, 40).coalesce(1)
    ingest.write_parquet(df, f"{base}/z")
    assert [tuple(x)[1:] for x in files.row_groups(spark, f"{base}/z").collect()] == [(0, 40, "ZSTD")]
    assert [tuple(x) for x in files.layout_summary(spark, f"{base}/z").collect()] == [("ZSTD", 1, 1, 40, 40)]
    ingest.require_layout(spark, f"{base}/z")
    with pytest.raises(ContractError):
        ingest.require_layout(spark, f"{base}/z", most_rows=39)
    df.write.option("compression", "snappy").parquet(f"{base}/s")
    with pytest.raises(ContractError):
        ingest.require_layout(spark, f"{base}/s")


def test_cached_parquet_is_used_again(spark, base):
    source = write_csv(spark, base, 20)
    assert ingest.cached_parquet(spark, source, f"{base}/p") == {"rows": 20, "reused": False}
    assert ingest.cached_parquet(spark, source, f"{base}/p") == {"rows": 20, "reused": True}
    audit_frame(spark, 5).select(*FEATURES, *LABELS).write.mode("append").options(header=True).csv(source)
    assert ingest.cached_parquet(spark, source, f"{base}/p") == {"rows": 25, "reused": False}


def test_row_ordinals_follow_file_names(spark, base):
    audit_frame(spark, 50).repartitionByRange(5, ROW_ID).sortWithinPartitions(ROW_ID).select(F.col(ROW_ID).cast("double").alias("f0"), *FEATURES[1:], *LABELS).write.options(header=True).csv(f"{base}/many")
    rows = ingest.with_row_ordinal(ingest.read_csv_typed(spark, f"{base}/many")).collect()
    assert len(rows) == 50 and all(r.f0 == r[ROW_ID] for r in rows)
    plain = ingest.with_row_ordinal(spark.range(7).repartition(3).select("id"))
    assert sorted(r[ROW_ID] for r in plain.collect()) == list(range(7))


def test_nan_is_null_at_the_scan(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",".join([*FEATURES, *LABELS]) + "\n" + ",".join(["NaN", *["1.5"] * 11, "1", "0", "0", "1"]) + "\n")
    for df in (ingest.read_csv_typed(spark, f"file://{tmp_path}/x.csv"), ingest.safe_cast(ingest.read_csv_text(spark, f"file://{tmp_path}/x.csv"))):
        row = df.first()
        assert row.f0 is None and row.f1 == 1.5


def test_run_is_write_once(spark, base):
    run = Run(spark, f"{base}/run")
    run.write_json("audit/a.json", {"x": 1})
    run.write_table("tables/t", audit_frame(spark))
    for again in (lambda: run.write_json("audit/a.json", {}), lambda: run.write_table("tables/t", audit_frame(spark)), lambda: run.write_text("other/x", ""), lambda: run.write_text("audit/../x", "")):
        with pytest.raises(ContractError):
            again()
    assert set(run.finish()["artifacts"]) == {"audit/a.json", "tables/t"}
    with pytest.raises(ContractError):
        run.write_text("audit/b.txt", "late")
    for text in ("the p-value is small", "AUUC = 3"):
        with pytest.raises(ContractError):
            check_language(text)
    check_language("this is not a p-value")


def test_promote_rolls_back(spark, base):
    for name, n in (("target", 5), ("new", 6), ("bad", 7)):
        audit_frame(spark, n).write.parquet(f"{base}/{name}")

    def fail(path):
        raise ValueError("no")

    with pytest.raises(ValueError):
        promote(spark, f"{base}/bad", f"{base}/target", fail)
    assert spark.read.parquet(f"{base}/target").count() == 5
    promote(spark, f"{base}/new", f"{base}/target", lambda p: None)
    assert spark.read.parquet(f"{base}/target").count() == 6


def test_streamed_counts_equal_batch(spark, base):
    df = audit_frame(spark, 60).select(*FEATURES, *LABELS, ROW_ID)
    df.repartition(3).write.parquet(f"{base}/s")
    stream = counts.joint_counts(counts.population_stream(spark, f"{base}/s"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", f"{base}/o").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.groupBy(TREATMENT, OUTCOME).count()
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, batch.collect()))
    assert counts.ate_of_counts(spark.table("streamed")).first().ate == pytest.approx(0.0)


def effect_frame(spark, n=1500):
    cols = [F.rand(k).alias(f) if k else (F.col("id") % 100 / 100.0).alias(f) for k, f in enumerate(FEATURES)]
    base = spark.range(n).select(F.col("id").alias(ROW_ID), *cols, (F.xxhash64("id") % 2 == 0).cast("long").alias(TREATMENT))
    chance = 0.2 + F.when((F.col(TREATMENT) == 1) & (F.col("f0") > 0.5), 0.5).otherwise(0.0)
    draw = F.pmod(F.xxhash64(ROW_ID, F.lit(5)), F.lit(1000)) / 1000.0
    return base.withColumn(OUTCOME, (draw < chance).cast("long"))


def test_learners(spark):
    df = effect_frame(spark, 600)
    config = learners.GbmConfig(rounds=4, leaves=4)
    assert config.digest() == learners.GbmConfig(rounds=4, leaves=4).digest() != learners.GbmConfig(rounds=3).digest()
    tau = learners.t_learner(df, df, config)
    high, low = (tau.where(c).agg(F.avg("tau")).first()[0] for c in ("f0 > 0.5", "f0 <= 0.5"))
    assert high > low + 0.1
    oof = learners.out_of_fold_surfaces(df, config)
    assert oof.where("fold = prediction_fold").count() == 0 and oof.select(ROW_ID).distinct().count() == 600
    x = learners.x_learner(df, df, config).agg(F.avg(F.when(F.col("f0") > 0.5, F.col("tau"))).alias("high"), F.avg(F.when(F.col("f0") <= 0.5, F.col("tau"))).alias("low")).first()
    assert x.high > x.low + 0.1
    with pytest.raises(ContractError):
        learners.fit_classifier(df.where("conversion = 1"), OUTCOME, config)
    with pytest.raises(ContractError):
        learners.fit_classifier(df, OUTCOME, config, df.limit(0))
