"""Tables in the shared folder, and the driver contract without the optional parts."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spectraloom import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_chains_keep_their_last_table_only(spark):
    before, seen = len(tables._written), []

    def step(df):
        on_the_way = tables.materialise(df.withColumn("x", F.col("x") + 1), "way")
        seen.append(on_the_way.inputFiles()[0])
        return on_the_way.where("x > 2")

    out = tables.chain(spark.range(5).withColumn("x", F.col("id")), [("one", step), ("two", step)])
    assert sorted(r.x for r in out.collect()) == [4, 5, 6] and len(tables._written) == before + 1
    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in seen)


def test_clusters_must_name_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: folder))

    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            tables.shared_folder(session(master))
        assert tables.shared_folder(session(master, "s3://b/c/")) == "s3://b/c"
    assert tables.shared_folder(session("local[4]")).startswith("file:///")


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_the_optional_parts(tmp_path, broken):
    for name in ("__spark_entry__.py", "spectraloom"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    optional = tmp_path / "spectraloom" / "llm"
    shutil.rmtree(optional, ignore_errors=True)
    if broken:
        # a subpackage that is there and can't be imported isn't taken for one that isn't
        optional.mkdir()
        (optional / "__init__.py").write_text("")
        (optional / "queries.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert (done.returncode == 0) is not broken, done.stderr
    assert not broken or "no_such_library" in done.stderr
