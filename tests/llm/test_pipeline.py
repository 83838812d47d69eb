"""The pipeline against brute force, stage by stage, on the smallest tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sextant.llm import bpe, quality, secrets

SF = "/root/testdata/sf0.001"


def near(texts):
    """The ids of one document a component, the smallest."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return {i for i in sets if label[i] == i}


def repeats(docs):
    """How often each (id, size, source, text) is taken, by sorting hashes."""
    per = {}
    for i, size, source, text in docs:
        per.setdefault(source, []).append((int(hashlib.md5(f"{i}:{source}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:15], 16), size, i))
    names = sorted(per)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(x[1] for x in per[s]) for s in names}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        free -= over
    w = sum(weight[s] for s in free)
    target |= {s: round(left * weight[s] / w, 6) for s in free}
    out = {}
    for s in names:
        whole = int(target[s] // total[s])
        budget, done, more = target[s] - whole * total[s], 0, True
        for _, size, i in sorted(per[s]):
            if more and done + size > budget:
                take, more = 2 * (budget - done) >= size and budget > 0, False
            else:
                take = more and budget > 0
            done += size
            out[i] = whole + take
    return out


def test_run_matches_brute_force(spark):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i: r.text for i, r in rows.items() if model.scores([r.text])[0] >= 0.3}
    kept = near(good)
    grammar = secrets.learn(docs.where(docs.doc_id.isin(sorted(kept))))
    texts = {i: secrets.redact(good[i], secrets.find(good[i], grammar)) for i in kept}
    times = repeats([(i, len(t.encode().split()), rows[i].source, t) for i, t in texts.items()])
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += times[i]
    assert got == +want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert dict(out.dtypes) == dict(docs.dtypes), name
