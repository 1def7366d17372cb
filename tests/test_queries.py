"""Every query of the narrative engine against its oracle, and plans that must stay native."""

import duckdb
import pandas as pd
import pytest

from inkstream.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PYTHON = {"attributed_dialogue", "character_profiles", "cast_voices", "locked_cast", "cast_conflicts", "partner_voices", "attributed_stream", "delivered_voices", "wav_round_trip", "speech_spectrum", "synthesized_audio", "html_prose", "rendered_marks", "flagship"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(df, cols):
    value = lambda v: None if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v) else list(v) if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(str([str(value(v)) for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, con, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got, cols) == plain(want, cols)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_every_sound_is_spoken(spark, data, con):
    """One sound for each distinct key of the delivered chunks, dialogue included."""
    keys = con.execute(queries.ORACLES["synth_dedupe"]).df().key
    got = queries.synthesized_audio(spark, data).toPandas()
    assert sorted(got.key) == sorted(keys) and got.error.isna().all() and (got.n_samples >= 240).all()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - PYTHON))
def test_native(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapIn", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_scans_read_what_they_need(spark, data):
    plan = queries.job_progress(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_type" in plan
    plan = queries.silence_bounds(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan


@pytest.mark.parametrize("name", ["rendered_marks", "synthesized_audio"])
def test_lengths_need_no_audio(spark, data, name):
    """Audio is thousands of times its text, so it must not leave the workers where only lengths are wanted."""
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "pcm" not in plan


def test_splitting_needs_no_shuffle(spark, data):
    for name in ("split_chapters", "chunk_prose", "clean_prose", "html_blocks"):
        assert "Exchange" not in queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString(), name


def test_small_files_are_spread(spark, tmp_path):
    """One row group is dealt over the cores; an input with a partition for each core, or a large one, is read as it lies."""
    from inkstream.plans import views

    spark.range(1000).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    df = spark.read.parquet(f"file://{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() == 1 and views.spread(df).rdd.getNumPartitions() == cores and views.spread(df).count() == 1000
    many = spark.range(1000).repartition(cores)
    assert views.spread(many) is many
    large = spark.range(1 << 40).coalesce(1)
    assert views.spread(large) is large


def test_entry_survives_without_training_operators(tmp_path):
    """The entry imports when the optional parts are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "inkstream"), tmp_path / "inkstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
