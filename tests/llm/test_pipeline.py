"""The pipeline on the smallest tables: every stage's decisions, against brute force."""

import collections
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from labelsift.llm import decontaminate, toxicity
from labelsift.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def holds(text, item):
    """Whether the text holds the benchmark item: every diagonal that has enough equal tokens is looked at."""
    t, i = decontaminate.normal_tokens(text), decontaminate.normal_tokens(item)
    least = min(decontaminate.LEAST, decontaminate.SHARE * len(i))
    places = collections.defaultdict(list)
    for k, w in enumerate(i):
        places[w].append(k)
    common = collections.Counter(j - k for j, w in enumerate(t) for k in places.get(w, ()))
    for shift in (d for d, n in common.items() if n >= least):
        low, high = max(0, shift), min(len(t), shift + len(i))
        if decontaminate.best_stretch(np.array([t[j] == i[j - shift] for j in range(low, high)]))[2] >= least:
            return True
    return False


def near(a, b, most=2):
    """Whether two lines are at most two edits apart, by the plain recurrence."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages(spark):
    docs = table(spark, DATA, "documents").select(*cp.COLUMNS)
    model = toxicity.learn(spark, docs, DATA)
    seen = {}
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, DATA), name)
        if name != "mixing":
            assert out.columns == cp.COLUMNS
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, out.collect())
        docs = out

    before, after = seen["toxicity"]
    reader = toxicity.Reader(model.chars, model.known)
    assert {r.doc_id for r in after} == {i for i, t in before.items() if model.score(reader.features(t)) < 0.5} != set(before)

    before, after = seen["line_dedup"]
    white = " \t\r\x0b\x0c"
    left = [(r.doc_id, line.strip(white)) for r in sorted(after, key=lambda r: r.doc_id) for line in r.text.split("\n")]
    worded = [line for _, line in left if any(ch.isalnum() for ch in line)]
    assert len(worded) == len(set(worded))
    # of the lines that are gone, each has a line two edits off, or itself, at an earlier place
    texts = {r.doc_id: r.text for r in after}
    kept = collections.defaultdict(set)
    for line in worded:
        kept[len(line)].add(line)
    every = collections.defaultdict(set)
    for t in before.values():
        for line in (t or "").split("\n"):
            every[len(line.strip(white))].add(line.strip(white))
    gone = collections.Counter(line.strip(white) for t in before.values() for line in (t or "").split("\n")) - collections.Counter(line for _, line in left)
    for line in list(gone)[:200]:
        own = line in kept[len(line)] or line == ""
        assert own or any(near(line, o) for n in range(len(line) - 2, len(line) + 3) for o in every[n] if o != line), line
    assert all(r.n_chars == len(r.text) for r in after) and set(texts) <= set(before)

    def sets(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    before, after = seen["ngram_jaccard"]
    s = {i: sets(t) for i, t in before.items()}
    ids, stay = sorted(s), {r.doc_id for r in after}
    pairs = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    assert not any(a in stay and b in stay for a, b in pairs)
    assert all(any(b == i for _, b in pairs) for i in set(ids) - stay)

    before, after = seen["decontamination"]
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    assert {r.doc_id for r in after} == {i for i, t in before.items() if not any(holds(t, item) for item in items)}

    before, after = seen["mixing"]
    assert all(0 < r.taken <= 3 * r["size"] for r in after) and {r.doc_id for r in after} <= set(before)
    assert {(r.doc_id, r.text, r.taken) for r in cp.run(spark, DATA).collect()} == {(r.doc_id, r.text, r.taken) for r in after}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages_take_empty_tables_nulls_and_clashing_columns(spark):
    docs = table(spark, DATA, "documents").select(*cp.COLUMNS)
    item = table(spark, DATA, "benchmark").where("text IS NOT NULL").first().text
    clashes = {c: F.lit(7) for c in ("_k", "_gone", "_new", "node", "size", "target", "taken", "key", "score", "predicted", "row", "left", "id", "_quality")}
    odd = spark.createDataFrame([(None, None, None, None, None), (None, item, "en", None, 3), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "one two", "en", None, 7), (3, "one two", "en", None, 7)], docs.schema)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        out = stage(spark, odd.withColumns(clashes), DATA)
        assert out.columns[: len(cp.COLUMNS)] == cp.COLUMNS
        got = [(r.doc_id, r.text) for r in out.collect()]
        # of the two rows of id 3, lines and near copies keep what the id keeps; the item goes with the rows of its id
        assert (3, "one two") in got and ((None, item) in got) == (name != "decontamination"), name
        assert name in ("mixing", "decontamination") or (1, None) in got and (2, "") in got


