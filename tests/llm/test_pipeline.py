"""The stages against plain Python over all rows, and on odd rows."""

from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from hustings.llm import bpe

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\r\x0b\x0c"


def words(t):
    return (t or "").encode().split()


def passes(t):
    w = words(t)
    n = len(w)
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    often = Counter(windows)
    repeated = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)})
    lines = [x for x in (t or "").split("\n") if x.strip(WHITE)]
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return not (
        n < 10 or 100 * repeated > 20 * n or 100 * symbols > 10 * n or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or chars < 2 * n or chars > 20 * n
    )


def groups(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = words((t or "").encode().lower().decode() if t else "")
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def written(spark, tmp_path, name, docs):
    """A stage's result, written and read again as ``run`` does it."""
    path = str(tmp_path / name.replace(" ", "-"))
    dict(cp.STAGES)[name](spark, docs, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality rules", "near duplicates", "substring dedup", "decontamination", "bpe"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = written(spark, tmp_path, "quality rules", docs)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept == {d: t for d, t in rows.items() if passes(t)} and 0 < len(kept) < len(rows)
    single = written(spark, tmp_path, "near duplicates", good)
    left = {r.doc_id: r.text for r in single.collect()}
    assert left == {d: kept[d] for d, g in groups(kept.items(), 5, 80).items() if d == g} and len(left) < len(kept)
    cut = written(spark, tmp_path, "substring dedup", single)
    assert cut.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts.keys() == left.keys() and all(n == len(t) for t, n in texts.values())
    freed = written(spark, tmp_path, "decontamination", cut)
    clean = {r.doc_id: r.text for r in freed.collect()}
    items = [" ".join(w.strip(".,").lower() for w in r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, (t, _) in texts.items():
        has = any(i in " ".join(w.strip(".,").lower() for w in t.split()) for i in items if i.count(" ") > 10)
        assert not (has and d in clean)
        assert d not in clean or clean[d] == t
    final = written(spark, tmp_path, "bpe", freed).collect()
    assert {r.doc_id for r in final} == clean.keys()
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in final:
        assert r.ids == library.encode(clean[r.doc_id], add_special_tokens=False).ids and r.decoded == clean[r.doc_id] and r.n_tokens == len(r.ids)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    text = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " more of it here"), (5, "other " + " ".join(f"x{i}" for i in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "key", "id", "digest", "_text", "_row", "n_words", "failed_bits", "kept", "_found", "_gone", "_removed", "__gone"):
        docs = docs.withColumn(name, F.lit(name))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, _ in cp.STAGES[:-1]:
            now = written(spark, tmp_path / str(empty), name, now)
            assert now.columns == docs.columns, name
            got = now.collect()
            assert all(r.key == "key" and r.n_words == "n_words" and r._text == "_text" for r in got)
        last = written(spark, tmp_path / str(empty), cp.STAGES[-1][0], now).collect()
        assert len(last) == len(got) and bool(got) != empty
