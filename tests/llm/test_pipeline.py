"""Each stage of the pipeline, on its own input, against brute force."""
from collections import defaultdict

import corpus_pipeline
from fieldscope.llm import mixing, quality
from llm import cases
from llm.test_minhash import expected as near
from llm.test_packing import padding_of
from llm.test_suffixes import expected as repeats

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], FOLDER).cache())
    raw, clean, single, left, mixed = map(rows_of, frames[:5])
    assert all(f.columns == docs.columns for f in frames[:5])
    assert clean == [r for r in raw if quality.first_rejecting(quality.RULES, quality.Features(r[1])) is None] and clean
    kept = {i for i, _, _, stays in near(clean, 5) if stays}
    assert sorted(single) == sorted(r for r in clean if r[0] in kept)
    sizes = {i: n - gone for i, n, gone, _, _ in repeats(single)}
    assert {r[0] for r in left} == set(sizes)
    assert all(0 <= sizes[r[0]] - len(r[1].encode()) <= 12 for r in left)  # but for halves of characters
    total = defaultdict(int)
    for r in left:
        total[r[3]] += len(r[1].split())
    order = sorted(total)
    want = mixing.fill([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(total.values()))
    taken = defaultdict(int)
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert [taken[s] for s in order] == [round(t) for t in want]
    packed = frames[5].collect()
    assert len(packed) == len(mixed) and sum(r.n_words for r in packed) == sum(taken.values())
    bounds = sorted({r.bucket_length for r in packed})
    assert sum(r.padding for r in packed) == padding_of([r.n_words for r in packed], bounds)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert got and len(corpus_pipeline.STAGES) == 5


def test_odd_rows_pass_through(spark, tmp_path):
    prose = "It was late in the year when the letters came and nobody in the small house by the river could say who had sent them. "
    rows = [*cases.DOCUMENTS, (50, prose + "One more.", None, None), (51, prose.replace("late", "early") * 1 + "Another end of it.", "en", "a")]
    got = corpus_pipeline.run(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and got
    assert corpus_pipeline.run(spark, cases.saved(cases.documents(spark, []), tmp_path / "none", "documents")).collect() == []
