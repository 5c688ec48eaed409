"""The pipeline against its five stages one after another in plain Python, and its stages on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from corpus_pipeline import STAGES, documents, run, tokenizer_path
from quire.llm.mixing import SEED
from tests.llm.data import SCHEMA, rows
from tests.llm.test_native import bare, n_words, targets
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_texts import junk_and_prose, slow_verdicts


def corpus():
    """Prose and junk, with copies that differ in white space only, and near copies."""
    r, found = random.Random(8), junk_and_prose()
    for text, lang, source in found[::6]:
        found.append((text.replace(" ", "  ", 3) + "\n", lang, r.choice(["a", "b"])))
    for text, lang, source in found[1:200:5]:
        words = text.split(" ")
        for _ in range(max(1, len(words) // r.choice([12, 40, 150]))):
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
        found.append((" ".join(words), lang, source))
    ids = r.sample(range(10_000), len(found))
    return [(i, *x) for i, x in zip(ids, found, strict=True)]


def brute_run(docs):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with how often each occurs, and the rows that each stage keeps."""
    from tokenizers import Tokenizer

    kept = [[d for d, good in zip(docs, slow_verdicts([d[1:] for d in docs]), strict=True) if good]]
    groups = defaultdict(list)
    for d in kept[-1]:
        groups[bare(d[1])].append(d)
    kept.append([min(g, key=lambda d: (-len(d[1]), d[0])) for g in groups.values()])
    stay = {i for _, i in brute_kept([d[1] for d in kept[-1]], [d[0] for d in kept[-1]])}
    kept.append([d for d in kept[-1] if d[0] in stay])
    sizes = defaultdict(int)
    for d in kept[-1]:
        sizes[d[3]] += n_words(d[1])
    wanted, taken = targets(sizes), []
    for d in kept[-1]:
        rate = wanted[d[3]] / sizes[d[3]]
        draw = int(hashlib.md5(f"{SEED} {d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        taken += [d] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    kept.append(taken)
    library, pieces = Tokenizer.from_file(tokenizer_path()), Counter()
    for d in taken:
        ids = np.array([*library.encode(d[1], add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            pieces[d[0], start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    return pieces, kept


def test_whole_run(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, kept = brute_run(docs)
    assert len(docs) > len(kept[0]) > len(kept[1]) > len(kept[2]) and len({d[0] for d in kept[3]}) < len(kept[3])
    found = run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        ends = np.cumsum([length for _, length in sorted(held)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(held)] == [0, *ends[:-1]]


def test_stages_take_effect(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark, str(tmp_path))
    columns, before = docs.columns, docs.count()
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before
        before = docs.count()
    packed = run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.where("start = 0").count() == docs.count()
