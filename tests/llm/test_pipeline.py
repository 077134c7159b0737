"""The pipeline against a brute-force version of all five stages on a whole small table."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from tests_llm_path import SF

import corpus_pipeline
from skyfold.llm import packing, quality
from skyfold.llm.queries import tokenizer_files

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text) if w]


def passes(line):
    n = len(words(line))
    symbols, segments = sum(c in quality.SYMBOLS for c in line), len(re.split(quality.SEPARATOR, line))
    fails = (3 * symbols > n or (n >= 20 and not re.search(quality.SENTENCE, line)) or re.search(quality.NAVIGATION, line)
             or (segments >= 3 and n <= 3 * segments) or re.search(quality.BOILERPLATE, line))
    return not n or not fails


def good(text):
    w = words(text)
    grams, hit = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(3)}
    clean = "\n".join(x for x in text.split("\n") if passes(x))
    whole = len("".join(w))
    lost = 1 - len("".join(words(clean))) / whole if whole else 0
    return clean if len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and lost <= 0.5 else None


def expected():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    docs = {i: c for i, x in zip(t["doc_id"], t["text"]) if (c := good(x or "")) is not None}
    seen, kept = set(), {}
    for i in sorted(docs):
        lines, gone = docs[i].split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if not any(map(words, w)):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        if len(gone) < len(lines):
            kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(x.encode().lower().decode())) else set() for i, x in kept.items()}
    least = {i: i for i in kept}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(kept)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    kept = {i: x for i, x in kept.items() if root(i) == i}
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    lower = lambda x: [m[0].lower() for m in token.finditer(x)]
    windows = set()
    for x in pq.read_table(f"{SF}/benchmark.parquet").to_pydict()["text"]:
        w = lower(x.encode())
        n = min(10, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    out, sizes = {}, {len(g) for g in windows}
    for i, x in kept.items():
        data = x.encode()
        at, w = [m.span() for m in token.finditer(data)], lower(data)
        hit = {p for k in range(len(w)) for n in sizes if tuple(w[k:k + n]) in windows for p in range(k, k + n)}
        if 2 * len(hit) > len(w):
            continue
        runs = [p for p in sorted(hit) if p - 1 not in hit]
        for p in reversed(runs):
            q = p
            while q + 1 in hit:
                q += 1
            data = data[:at[p][0]] + data[at[q][1]:]
        out[i] = data.decode()
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer
    exact, want = Tokenizer.from_file(tokenizer_files()[0]), []
    for i, text in expected().items():
        ids = np.array(exact.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        want += [(i, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for k, (s, n) in enumerate(packing.cut_points(len(ids) // 4, 1024))]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(want) > 100
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1), (None, "a b", "en", "s", 3, 2), (2, " ".join(f"w{i}." for i in range(80)), None, None, None, 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, quality long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality"], name
    assert [r["doc_id"] for r in docs.collect()] == [2]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
