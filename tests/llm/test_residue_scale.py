"""What is found does not depend on how large the collection is."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sedimark.llm import residue
from sedimark.llm.residue import judge, train
from tests.llm.test_residue import PROSE

NOUNS = "ledger ticket sensor route folder depot gauge marker".split()
CASES = [
    *(f"Please enable JavaScript to view the {n} page." for n in NOUNS),
    *(f"The link to this {n} document has expired or the document has been removed by its owner." for n in NOUNS),
    "The requested page /docs/x was not found on this server.", "Too many requests. You have been rate limited; retry in 30 seconds.", "Su sesión ha caducado, vuelva a identificarse para abrir ledger.", "Content coming soon.\n\nCheck back later for the ledger section.",
    "asdf asdf\nasdf jkl jkl asdf", "test test 123\ntest test", "Text goes here. More text goes here.", "Sample text. Sample text.", "xxxxx xxxxx xxxxx\nxxxxx xxxxx", "TBD\n\nTBD\n\nTBD",
]


@pytest.mark.parametrize("times", [1, 20_000])
def test_occurrences_grow(monkeypatch, times):
    """As much text as 6 GB of documents hold: nothing is learned by heart, and no probability becomes zero."""
    once = residue._tally
    monkeypatch.setattr(residue, "_tally", lambda texts: Counter({w: n * times for w, n in once(texts).items()}))
    texts = CASES + PROSE
    models = train(PROSE * 40 + CASES)
    assert np.isfinite(models.ratios(texts + ["проверка 索引 ☂"])).all()
    assert {t for t, j in zip(texts, judge(texts, models)) if j[0]} == set(CASES)


def test_data_are_not_counted():
    """Unbroken runs are no case whatever the models say, and fill no bucket."""
    rng = random.Random(1)
    data = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz+/", k=3_000)) for _ in range(100)]
    assert np.array_equal(train(PROSE + CASES + data).counts, train(PROSE + CASES).counts)


def test_a_table_twenty_thousand_times():
    """The counts of a table of 1,000 documents multiplied: the same documents come out."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    once = residue._tally
    found = []
    for times in (1, 200, 20_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(residue, "_tally", lambda texts: Counter({w: n * times for w, n in once(texts).items()}))
            found.append([j[0] for j in judge(texts, train(texts))])
    assert found[1] == found[0] and found[2] == found[0]
