"""The pipeline, stage by stage."""

import corpus_pipeline
import plain
import pytest

from veilwork.llm import mixing
from veilwork.llm.tables import Workspace, read

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage works on what the one before kept, and its decisions take effect."""
    import sentencepiece

    work, docs, seen = Workspace(spark, "test-pipeline"), read(spark, SF, "documents"), []
    columns = docs.columns
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(docs)
        docs = work.save(stage(spark, docs, SF), f"s{nth}")
        assert docs.columns == columns or nth == 4
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]

    def good(text):
        m = plain.repetition(text)
        n = m["n_words"]
        return (n >= 20 and 100 * m["n_repeat_words"] <= 30 * n and m["covered_words"] <= 0.3 * n
                and m["longest_repeat"] <= 0.15 * n)

    assert set(texts[1]) == {i for i, t in texts[0].items() if len(t) > 20000 and i in texts[1] or len(t) <= 20000 and good(t)}
    assert set(texts[2]) <= set(texts[1]) and len(texts[2]) >= 0.98 * len(texts[1])
    classes = plain.near_duplicates(texts[2])
    assert sorted(texts[3]) == sorted({c for c, _ in classes.values()})
    copies = {r.row.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    taken = [r.doc_id for r in seen[4].collect()]
    assert sorted(taken) == sorted(i for i, n in copies.items() for _ in range(n))
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == sorted(taken)
    assert all(r.ids == model.encode(texts[4][r.doc_id]) and r.round_trip for r in rows)


def test_odd_documents(spark):
    """NULLs, repeats, an extra column and an empty table go through all stages."""
    rows = [(i, t, "en", None, 1, "extra") for i, t in enumerate(plain.ODD_TEXTS)] * 2 + [(None,) * 6]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for frame in (docs, docs.where("false")):
        work = Workspace(spark, "test-odd")
        for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns or nth == 4
            frame = work.save(out, f"s{nth}")
        ids = [r.doc_id for r in frame.collect()]
        assert set(ids) <= {len(plain.ODD_TEXTS) - 1}


def _odd(spark):
    rows = [(i, t, "en", "s" if i % 2 else None, 1, "extra") for i, t in enumerate(plain.ODD_TEXTS)]
    rows += [rows[4], rows[4], rows[0], (None,) * 6, (None, "a text without an id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def _texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


@pytest.mark.parametrize("nth", range(5))
def test_every_stage_takes_odd_rows(spark, nth):
    """Each stage by itself, as earlier ones let hardly any odd row pass."""
    docs, stage = _odd(spark), corpus_pipeline.STAGES[nth][1]
    out = stage(spark, docs, SF)
    assert stage(spark, docs.where("false"), SF).count() == 0
    if nth == 4:
        found = out.collect()
        assert sorted(str(r.doc_id) for r in found) == sorted(i for i, _ in _texts(docs))
        assert all(r.ids == [] for r in found if r.doc_id in (0, 1)) and all(r.round_trip for r in found)
        return
    assert out.columns == docs.columns
    every, kept = _texts(docs), _texts(out)
    assert set(kept) <= set(every)
    ids = {i for i, _ in kept}
    if nth == 0:
        assert ids == {str(len(plain.ODD_TEXTS) - 1)}
    elif nth == 1:
        assert not ids & {"0", "1", "2", "3", "12"}
    elif nth == 2:
        wordless = [x for x in every if x[1] == "None" or not x[1].split()]
        assert all(kept.count(x) == every.count(x) for x in wordless)
        assert kept.count(("4", "word")) == 1 and ("6", "a b c d") not in kept and ("5", "a b c d") in kept
    else:
        copies = {(str(r.row.doc_id), str(r.row.text)): 0 for r in mixing.mix(docs).collect()}
        for r in mixing.mix(docs).collect():
            copies[str(r.row.doc_id), str(r.row.text)] += r.copies
        assert {x: kept.count(x) for x in set(every)} == copies
