import datetime as dt
import random

import numpy as np

from sedimark.operators.orphans import Bitmap, code_orphans, orphans

T0 = dt.datetime(2025, 1, 1)
at = lambda h: T0 + dt.timedelta(hours=h)


def test_bitmap():
    rng = np.random.default_rng(0)
    a, b = rng.choice(300_000, 20_000, replace=False), rng.choice(300_000, 90_000, replace=False)
    assert Bitmap(a).and_not(Bitmap(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert Bitmap(np.array([])).and_not(Bitmap(a)).tolist() == [] and Bitmap(np.array([5, 5, 70_000])).and_not(Bitmap(np.array([]))).tolist() == [5, 70_000]


def test_against_brute_force(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(40)]
    parents = []
    for k in keys[:30]:
        for _ in range(rng.randrange(0, 4)):
            a = rng.randrange(0, 4000)
            parents.append((k, at(a), None if rng.random() < 0.3 else at(a + rng.randrange(0, 1500))))
    hot = ["k0"] * 400
    refs = [(f"r{i}", rng.sample(keys, rng.randrange(0, 4)) if i >= 400 else [hot[i]], at(rng.randrange(0, 5000))) for i in range(1200)]
    want = {r for r, ks, t in refs if not any(k in ks and a <= t and (b is None or t < b) for k, a, b in parents)}
    refs_df = spark.createDataFrame(refs, "ref string, keys array<string>, at timestamp")
    parents_df = spark.createDataFrame(parents * 2 + [(None, T0, None), ("k1", None, None)], "key string, since timestamp, until timestamp")
    assert {r.ref for r in orphans(refs_df, parents_df).collect()} == want
    assert orphans(refs_df.limit(0), parents_df).count() == 0
    assert orphans(refs_df, parents_df.limit(0)).count() == 1200


def test_code_references(spark):
    chunks = spark.createDataFrame(
        [("r/src/a/x.ts", "X,Y", at(0), None, "k"), ("r/src/lib/index.ts", "L", at(100), None, "k"), ("r/src/old.ts", "Old", at(0), at(50), "k"), ("q/src/z.ts", "Z", at(0), None, "k"), ("r/p/core/m.py", None, at(0), None, "k"), ("r/p/pkg/__init__.py", "", at(0), None, "k"), (None, "N", at(0), None, "k")],
        "source string, class_name string, indexed_at timestamp, deleted_at timestamp, key string",
    )
    packages = spark.createDataFrame([("@a/b", at(0), None), ("left", at(0), at(60)), ("os", at(0), None)], "package_name string, listed_at timestamp, removed_at timestamp")
    s = "r/src/a/b.ts"
    good = [("g1", s, "./x", "import"), ("g2", s, " '../lib' ", "import"), ("g3", s, "../old.ts", "import"), ("g4", s, "X", "depends_on"), ("g5", s, " Y ", "depends_on"), ("g6", s, "@a/b/c", "import"), ("g7", s, "left/x", "import"), ("g8", "r/p/q/n.py", "from ..core.m import A, B", "import"), ("g9", "r/p/n.py", "from .pkg import A", "import"), ("g10", s, "import os.path as p", "import"), ("g11", s, "--tone", "depends_on"), ("g12", "r/p/pkg/n.py", "from . import A", "import")]
    bad = [("b1", s, "./X", "import"), ("b2", s, "../../../../x", "import"), ("b3", s, ".../x", "import"), ("b4", s, "Z", "depends_on"), ("b5", s, "@a/c", "import"), ("b6", s, "lefts", "import"), ("b7", "r/p/n.py", "from .core.q import A", "import"), ("b8", s, "from oss import x", "import"), ("b9", s, "x,y", "depends_on"), ("b10", "r/n.py", "from ...a import b", "import")]
    when = {i: at(10) for i, *_ in good + bad} | {"g2": at(100), "g3": at(49)}
    rows = [(*r, when[r[0]], 1) for r in good + bad] + [("g3", s, "../old.ts", "import", at(80), 1), ("b4", s, "Z", "depends_on", at(90), 1), ("late", s, "../lib", "import", at(99), 1), ("gone", s, "Old", "depends_on", at(50), 1), (None, s, "q", "import", at(1), 1), ("n1", None, "q", "import", at(1), 1), ("n2", s, None, "import", at(1), 1), ("n3", s, "q", "import", None, 1), ("n4", s, "q", None, at(1), 1)]
    edges = spark.createDataFrame(rows, "id string, source_file string, target_symbol string, relationship_type string, recorded_at timestamp, keys int")
    got = {r.id: r.recorded_at for r in code_orphans(edges, chunks, packages).collect()}
    assert set(got) == {b[0] for b in bad} | {"late", "gone"} and got["b4"] == at(10)
