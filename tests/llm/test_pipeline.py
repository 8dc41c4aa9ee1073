"""Each stage of the pipeline against its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lumentrace.llm.common import materialise, table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.collect()
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_quality(stages):
    text = {r["doc_id"]: r["text"] for r in stages["input"]}
    failed = {d for d, t in text.items() if brute.quality(t)[-1]}
    kept = {r["doc_id"]: r["text"] for r in stages["quality_rules"]}
    assert not failed & set(kept) and len(kept) >= 0.95 * len(set(text) - failed)
    for d, t in kept.items():
        assert set(t.split("\n")) <= set(text[d].split("\n"))


def test_near_dedup(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality_rules"]]
    parts, _ = brute.near(rows, 80)
    assert ids(stages["near_dedup"]) == set(parts.values())


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_dedup"]}
    assert ids(stages["secret_scans"]) == set(before)
    for r in stages["secret_scans"]:
        if brute.secrets(before[r["doc_id"]])[4]:
            assert not brute.secrets(r["text"])[4] and "[secret]" in r["text"]
        assert r["n_chars"] == len(r["text"])


def test_mixing(stages):
    sizes, source, taken = {}, {}, defaultdict(int)
    for r in stages["secret_scans"]:
        sizes[r["doc_id"]] = len(brute.WORD.findall(r["text"]))
        source[r["doc_id"]] = r["source"]
    copies = Counter(r["doc_id"] for r in stages["mixing"])
    assert set(copies) <= set(sizes) and max(copies.values()) <= 3
    total = defaultdict(int)
    for d, n in sizes.items():
        total[source[d]] += n
        taken[source[d]] += n * copies[d]
    for s, target in brute.targets(total).items():
        assert abs(taken[s] - target) <= 2 * max(n for d, n in sizes.items() if source[d] == s)


def test_packing(stages):
    copies = Counter(r["doc_id"] for r in stages["mixing"])
    ends = Counter(r["doc_id"] for r in stages["packing"] if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == copies
    fill = Counter()
    for r in stages["packing"]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"])
