import random

import pytest
from test_operators import slow_alignment, slow_components

from trailspark.llm import decontam, linededup, pieces
from trailspark.llm.entry import piece_model
from trailspark.operators.lineage import sweep

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_act_on_what_was_planted(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item, base = words(30), words(60)
    rows = [(k, words(40) + (" idiot scum" if k % 10 == 0 else ""), "en", f"s{k % 9}", 1) for k in range(200)]
    rows += [(200 + k, base if k else base + " more", "en", "s1", 1) for k in range(3)] + [(210, f"{words(20)} {item}", "en", "s1", 1)] + [(220 + k, f"{words(20)}\nthe same footer line", "en", f"s{k}", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {k for k in range(0, 200, 10)} - {201, 202, 210}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]


def brute_force(rows, items):
    """The stages after toxicity, in plain Python: kept doc_id and text."""
    docs = {i: t for i, t, *_ in rows}
    site = {i: s for i, _, _, s, _ in rows}
    seen = {}
    for i in sorted(docs):
        for k, line in enumerate(docs[i].split("\n")):
            line = " ".join(line.split()).lower()
            if len(line.split()) >= 3:
                seen.setdefault(line, []).append((i, k))
    wide = {line: places[0] for line, places in seen.items() if len({site[i] for i, _ in places}) >= 4}
    kept = {}
    for i, t in docs.items():
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if wide.get(" ".join(x.split()).lower(), (i, k)) == (i, k)]
        if len(left) == len(lines) or "\n".join(left).strip():
            kept[i] = "\n".join(left)
    ids = sorted(kept)
    comp = slow_components([kept[i] for i in ids], 5, 80)
    kept = {i: kept[i] for k, i in enumerate(ids) if comp[k][1] == k}
    bag = decontam.Words()
    tests = bag.of(items)
    own = dict(zip(kept, bag.of(list(kept.values()))))
    return {i: t for i, t in kept.items() if not any(slow_alignment(x.tolist(), own[i].tolist()) / (2 * len(x)) >= 0.5 for x in tests)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items, footer = [words(20), words(8)], "all the same footer"
    rows = []
    for k in range(120):
        text = words(rng.randint(3, 40))
        if rows and rng.random() < 0.2:
            near = rng.choice(rows)[1].split(" ")
            if len(near) > 20:
                near[rng.randrange(len(near))] = "edited"
            text = " ".join(near)
        if rng.random() < 0.3:
            text += f"\n{footer}" + ("\n" + words(4) if rng.random() < 0.5 else "")
        if rng.random() < 0.1:
            text = footer
        if rng.random() < 0.1:
            part = items[k % 2].split()
            part[rng.randrange(len(part))] = "changed"
            text += " " + " ".join(part)
        rows.append((k, text, "en", f"s{k % 6}", len(text)))
    toxic = [(200 + k, f"{words(12)} idiot scum", "en", "s1", 1) for k in range(30)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sp = pieces.load(piece_model())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: sp.encode(t, add_eos=True) for i, t in brute_force(rows, items).items()}


def test_stages_on_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "other words of this id", "en", "s", 1), (None, "no id at all here", "en", "s", 1), (3, "twice the same row", "en", "s", 1), (3, "twice the same row", "en", "s", 1), (4, "x" * 300_000, "en", "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, kind)
    texts = lambda df: sorted((r.text for r in df.collect()), key=repr)
    all_of = sorted((r[1] for r in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        want = list(all_of)
        if name == "ngram_join":
            want.remove("twice the same row")
        assert out.columns == docs.columns and texts(out) == want
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(rows) and sorted(r.n_tokens for r in out)[:2] == [1, 1]


def test_stages_chain_unwritten_and_runs_share_a_process(spark, tmp_path):
    """Lazy results of stages read each other's tables; two runs don't take each other's; what nobody reads any more goes."""
    rng = random.Random(31)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(k, words(30) + f"\nthe same footer line{' idiot scum' if k % 5 == 0 else ''}", "en", f"s{k % 7}", 1) for k in range(40)]
    rows += [(100 + k, *rows[1][1:]) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    first, second = corpus_pipeline.run(spark, d), corpus_pipeline.run(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, d)
    plain = lambda df: sorted((r.doc_id, r.n_tokens, r.ids) for r in df.collect())
    assert plain(docs) == plain(first) == plain(second)
    del docs
    for _ in range(20):
        if not (left := sweep(spark, collect=True)):
            break
    assert left == 0


def test_a_text_of_many_lines_takes_linear_time(spark):
    lines = [f"line number {i} of it" if i % 2 else "the common line here" for i in range(200_000)]
    docs = spark.createDataFrame([(k, "\n".join(lines) if k == 4 else "the common line here", f"s{k}") for k in range(5)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: ("the common line here", 0), **{k: ("", 1) for k in (1, 2, 3)}, 4: ("\n".join(lines[1::2]), 100_000)}
