"""Plain versions of the operators' contracts, in Python, over lists of dicts."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(_LOWER)
        return k if len(k) >= min_chars else None

    holders = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            if (k := key(line)) is not None:
                holders[k].add(d["doc_id"])
    out = {}
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if (k := key(x)) is None or len(holders[k]) < min_docs or max(holders[k]) == d["doc_id"]]
        out[d["doc_id"]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingle_set(text, words):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def near_duplicates(docs, words=2, percent=80):
    sets = {d["doc_id"]: shingle_set(d["text"], words) for d in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, s in sorted(sets.items()):
        common = defaultdict(int)
        for g in s:
            for other in having[g]:
                common[other] += 1
            having[g].append(k)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Share the words by weight; what exceeds a cap goes round again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, z) for a, k, z in sorted(out)]


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def pii_spans(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def span_sha(spans):
    return sha(",".join(f"{k}:{a}:{z}" for k, a, z in spans))


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        own = phrase.split()
        found += [(k, label) for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def license_labels(text, least=0.6):
    """Labels of phrases and of templates whose words stand in the text, in order and close together; the best coverage.

    Plain and slow: for every window of a template's length and a half the longest common subsequence.
    """
    from entroflow.llm.licenses import TEMPLATES

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    phrases = license_places(text)
    labels, best = set(phrases[4].split(",")) - {""}, 1.0 if phrases[1] else 0.0
    found = []
    for template, label in TEMPLATES:
        t = template.split()
        grams = {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        for k in range(len(words)):
            if tuple(words[k : k + 3]) in grams:
                own, row = words[k : k + len(t) * 3 // 2], [0] * (len(t) + 1)
                for w in own:
                    row = [0, *itertools.accumulate(range(1, len(t) + 1), lambda left, j, w=w, row=row: row[j - 1] + 1 if t[j - 1] == w else max(row[j], left), initial=0)][1:]
                if row[-1] / len(t) >= least:
                    found.append((k, row[-1] / len(t), label))
    for k, c, label in found:
        if c == max(x[1] for x in found if abs(x[0] - k) <= 8):
            labels.add(label)
            best = max(best, c)
    return ",".join(sorted(labels)), best


_TERM = re.compile(r"[^\W\d_](?:[^\W_]){2,}")


def disclosing_terms(docs, share=0.8, support=3):
    """Terms that disclose a value: pointwise mutual information over distinct documents."""
    docs = {(d["doc_id"], d["text"] or "") for d in docs}
    holders, having, both = defaultdict(set), defaultdict(set), defaultdict(set)
    for d in docs:
        spans = pii_spans(d[1])
        for w in _TERM.findall(d[1]):
            having[w.lower()].add(d)
        outside = list(d[1])
        for _, a, z in spans:
            outside[a:z] = "\0" * (z - a)
        own = {w.lower() for w in _TERM.findall("".join(outside))}
        for k, a, z in spans:
            holders[k, d[1][a:z]].add(d)
            for w in own:
                both[k, d[1][a:z], w].add(d)
    out = set()
    for (k, v, w), together in both.items():
        n, h, t = len(docs), len(holders[k, v]), len(together)
        if t >= support and h < n and math.log2(n * t / (len(having[w]) * h)) >= share * math.log2(n / h) - 1e-12:
            out.add(w)
    return out


def term_spans(text, base, terms):
    found = [("term", m.start(), m.end()) for m in _TERM.finditer(text or "") if m[0].lower() in terms]
    return [x for x in found if not any(a < x[2] and x[1] < z for _, a, z in base)]


def alignment(docs, a_path, b_path):
    """Whole texts through the two libraries, links by walking over both token lists, counts over all documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    rows, held = [], defaultdict(int)
    for d in docs:
        text, links, groups, a, b = d["text"] or "", [], [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_raw = [bytes(byte[c] for c in a_lib.id_to_token(k)) for k in a]
            b_raw = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_lib.id_to_piece(k)]]
            if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a, b = [], []
        i = j = a_end = b_end = first_a = first_b = 0
        if a:
            a_end, b_end = len(a_raw[0]), len(b_raw[0])
        while i < len(a):
            links.append((a[i], b[j]))
            if a_end == b_end:
                groups.append(",".join(map(str, a[first_a : i + 1])) + "|" + ",".join(map(str, b[first_b : j + 1])))
                first_a, first_b = i + 1, j + 1
            step_a, step_b = a_end <= b_end, b_end <= a_end
            if step_a:
                i += 1
                a_end += len(a_raw[i]) if i < len(a) else 0
            if step_b:
                j += 1
                b_end += len(b_raw[j]) if j < len(b) else 0
        for x in set(links):
            held[x] += 1
        rows.append((d["doc_id"], len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = [(d, n, m, g, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(t.encode()).hexdigest() if n else "") for d, n, m, g, x, t in rows]
    return out, dict(held)


def clusters(rows, clusters=16, rounds=3, width=64, scale=64, seed=1):
    """Lloyd's rounds over every row, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in order[:clusters]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    near = lambda q: min((far(q, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = defaultdict(int)
    for _, k, d in found:
        inertia[k] += d
    return [(i, k, d, inertia[k], sum(inertia.values())) for i, k, d in found], centres
