"""Plain statements of what the pipeline's stages have to do."""

import re

INSULTS = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}


def brute_toxic(docs, rejected):
    """Few documents without and most with an English insult are rejected: the training rows are few here."""
    bad = {d for d, r in docs.items() if INSULTS & set(re.findall(r"[a-z]+", r.text.lower()))}
    clean = set(docs) - bad
    return len(rejected & bad) >= 0.5 * len(bad) and len(rejected & clean) <= 0.15 * len(clean)


def shingle_set(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def classes_of(docs):
    ids = sorted(docs)
    sets, label = [shingle_set(docs[d].text) for d in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for d, x in zip(ids, label, strict=True):
        groups.setdefault(x, set()).add(d)
    return list(groups.values())


def pieces_of(pieces):
    total, have = {}, {}
    for r in pieces:
        total[r.doc_id] = r.doc_tokens
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert total == have
    return set(have)
