"""Models on workers that lack the package; frequent lines of many equal documents; recall and accuracy on rows nothing learned from."""

import os
import pickle
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from gridspark.llm import gam_quality, language_id, line_frequency, pii_tagger
from gridspark.llm.text import may_hold, utf8_views

TEXTS = ["the cat sat on the mat " * 5, "le chat est sur le tapis " * 5, "call +1 555 010 9999 or mail a.b@example.org", ""]


def away(tmp_path, thing, use):
    """What ``use`` gives for ``thing`` in a Python process that cannot import the package."""
    job = tmp_path / "job"
    job.write_bytes(cloudpickle.dumps((thing, use)))
    code = f"""
import pickle, sys
try:
    import gridspark
    sys.exit("the package is here")
except ImportError:
    pass
thing, use = pickle.load(open({str(job)!r}, "rb"))
sys.stdout.buffer.write(pickle.dumps(use(thing)))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return pickle.loads(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True).stdout)


def test_models_travel_with_their_code(tmp_path):
    net = language_id.train([t.encode() for t in TEXTS[:2] * 8], ["en", "fr"] * 8, steps=5)

    def languages(net):
        return language_id._pooled(net, list(utf8_views(pa.array(TEXTS)))).tolist()

    assert np.allclose(away(tmp_path, net, languages), languages(net))
    tagger = pii_tagger.train(TEXTS * 4, steps=5)

    def spans(tagger):
        return pii_tagger.find_spans(tagger, TEXTS)

    assert away(tmp_path, tagger, spans) == spans(tagger)
    rng = np.random.default_rng(1)
    model = gam_quality.train(rng.random((200, len(gam_quality.FEATURES))), (rng.random(200) > 0.5).astype(float))

    def scores(model):
        return model.score(gam_quality._matrix(pa.array(TEXTS))).tolist()

    assert np.allclose(away(tmp_path, model, scores), scores(model))


@pytest.mark.parametrize("hot", [2, 1 << 40])
def test_frequent_lines_by_brute_force(spark, monkeypatch, hot):
    """A third of the rows are one document, ids repeat or are null; with HOT high enough every digest is salted."""
    monkeypatch.setattr(line_frequency, "HOT", hot)
    rng = random.Random(3)
    lines = [f"Line NUMBER {i} of many" for i in range(9)] + ["", "  ", "héé\tx"] + [f"{chr(97 + i // 26)}{chr(97 + i % 26)} rare" for i in range(600)]
    texts = ["\n".join(rng.choices(lines, [30] * 9 + [5] * 3 + [1] * 600, k=rng.randrange(12))) for _ in range(150)] + [None, ""]
    texts += [texts[0] + "\nline number 4 of many"] * 80
    rows = [(rng.choice([None, i, 7]), t, rng.choice(["a", "a\n", None])) for i, t in enumerate(texts)]
    docs = defaultdict(Counter)
    split = [(d, h, t, [(x, line_frequency.normalise(x.encode())) for x in t.split("\n")] if t is not None else []) for d, t, h in rows]
    for _, h, _, parts in split:
        docs[h].update({clean for _, clean in parts if clean})
    want = Counter()
    for d, h, t, parts in split:
        gone = [clean for _, clean in parts if docs[h][clean] > 20]
        left = "\n".join(x for x, clean in parts if docs[h][clean] <= 20) if t is not None else None
        want[(d, h, left, len((t or "").split()), sum(len(c.split()) for c in gone))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = line_frequency.cut_frequent_lines(df, max_docs=20).collect()
    assert Counter((r.doc_id, r.host, r.text, r.n_words, r.removed_words) for r in found) == want


def test_bitmaps_miss_no_key(spark):
    rows = spark.range(3000).selectExpr("id", "unhex(md5(cast(id as string))) AS key")
    found = may_hold(rows, rows.where("id % 10 = 3"), "key", "may").collect()
    assert all(r.may for r in found if r.id % 10 == 3)
    assert sum(r.may for r in found) < 310
    assert not any(r.may for r in may_hold(rows, rows.limit(0), "key", "may").collect())
