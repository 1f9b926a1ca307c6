"""The corpus pipeline stage by stage, each held against a brute-force version on its own input."""

import hashlib

import pytest

pytest.importorskip("platen.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from platen.llm import line_dedup, mixing, ngram_join, quality  # noqa: E402
from tests.llm.test_operators import brute_components, docs_of, edit_distance  # noqa: E402


def sentences(seed, count):
    import random

    r = random.Random(seed)
    words = "the of and to in that for it as was on are with this be lamp river stone cloud garden winter letter harbour market bridge candle".split()
    return [" ".join(r.choice(words) for _ in range(14)).capitalize() + "." for _ in range(count)]


@pytest.fixture(scope="module")
def texts():
    lines = sentences(1, 400)
    out = ["\n".join(lines[k * 8 : k * 8 + 8]) for k in range(40)]
    out += [out[0], out[1].replace("lamp", "lamb", 1), "\n".join(lines[0:3] + sentences(2, 6)), "too short", "", None]
    out += ["$$$ ### %%% &&& *** " * 30, ("again and again and " * 40).strip()]
    return out


def test_stages(spark, tmp_path, texts):
    docs, columns = docs_of(spark, texts), docs_of(spark, texts).columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, None).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in after.collect()}
        if k < 4:
            assert after.columns == columns and set(rows) <= set(before)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge_quality(docs).collect() if r.kept}
            assert set(rows) == kept and set(range(40)) <= kept and not kept & {43, 44, 45, 47}
        elif name == "line_dedup":
            earlier = []
            for i in sorted(before):
                left = []
                for line in before[i].text.split("\n"):
                    long = len(line) >= line_dedup.MIN_CHARS
                    if not (long and any(abs(len(line) - len(e)) < 2 and edit_distance(line, e) <= 1 for e in earlier)):
                        left.append(line)
                    if long:
                        earlier.append(line)
                text = "\n".join(left)
                if text == before[i].text or text.strip(" "):
                    assert rows[i].text == text and rows[i].n_chars == len(text)
                else:
                    assert i not in rows
        elif name == "ngram_jaccard_join":
            ids = sorted(before)
            _, roots = brute_components([before[i].text for i in ids], 5, 80)
            assert set(rows) == {i for place, i in enumerate(ids) if roots[place] == place}
            assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {i: ids[roots[place]] for place, i in enumerate(ids)}
        elif name == "mixing":
            assert set(rows) == {r.doc_id for r in mixing.mix(docs).collect() if r.sampled}
        else:
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
        docs = after


def test_run_over_a_table(spark, tmp_path, texts):
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs_of(spark, texts).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
