"""Plain versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_blocks(docs, tokenizer, end=2):
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def rendered(found, kinds):
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted((s, kinds.index(k), e, k) for k, s, e in found)]


def secret_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_base(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def components(docs, size=3, percent=90):
    """doc_id -> (set size, component)."""
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(k)
    common = defaultdict(int)
    for at in by.values():
        at = sorted(at)
        for i, a in enumerate(at):
            for b in at[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(sets[a][0]), find(sets[b][0])
            root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]


def repeats(docs, length=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                k = b[i : i + length]
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def nearest(vectors, is_query, n=20):
    ids = np.array([v for v, _ in vectors])
    m = np.array([e for _, e in vectors], float)
    out = {}
    for k in np.flatnonzero([is_query(v) for v in ids]):
        score = (m[k] * m).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:n]
        out[int(ids[k])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def secrets(docs, kinds=("assign", "access", "hex", "live")):
    """(doc_id, spans, n_live, n_example, n_repositories, n_owners) of (doc_id, text, source, lang)."""
    found, owners, repositories = [], defaultdict(set), defaultdict(set)
    for _, text, source, lang in docs:
        text = text or ""
        base = [(m.start(), m.end(), m[2], "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        base += [(m.start(), m.end(), m[0], "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), m.end(), m[0], "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        more = [(m.start(), m.end(), m[0], "live") for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        more = [x for x in more if not any(b[0] < x[1] and x[0] < b[1] for b in base)]
        found.append((base, more))
        for x in base + more:
            owners[x[2]].add((source,))
            repositories[x[2]].add((source, lang))
    rare = {v: len(owners[v]) <= 2 and len(repositories[v]) <= 4 for v in owners}
    live = {v for v in rare if rare[v] and len(set(v)) >= 10}
    out = []
    for (doc_id, *_), (base, more) in zip(docs, found, strict=True):
        spans = base + [x for x in more if x[2] in live]
        values = {x[2] for x in base + more}
        text = ",".join(f"{k}:{a}:{b}" for a, b, _, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[3]), x[1])))
        out.append((doc_id, text, len(values & live), sum(not rare[v] for v in values), max((len(repositories[v]) for v in values), default=0), max((len(owners[v]) for v in values), default=0)))
    return out


def confident_contexts(edges, rounds=3, support=3, least=0.8, shape_weight=0.5):
    """Contexts of high confidence from (context, shape, value, seed)."""
    graph, seeds = defaultdict(set), defaultdict(float)
    for context, shape, value, seed in edges:
        graph["context", context].add(value)
        graph["shape", shape].add(value)
        seeds[value] = max(seeds[value], float(seed))
    scores = dict(seeds)
    for k in range(rounds):
        patterns = {p: sum(scores[v] for v in vs) / len(vs) for p, vs in graph.items() if sum(scores[v] >= least for v in vs) >= support}
        if k + 1 < rounds:
            doubt = defaultdict(lambda: 1.0)
            for (kind, p), confidence in patterns.items():
                for v in graph[kind, p]:
                    doubt[v] *= 1 - min(confidence, 0.999) * (shape_weight if kind == "shape" else 1)
            scores = {v: max(seeds[v], 1 - doubt[v]) for v in seeds}
    return {p for (kind, p), confidence in patterns.items() if kind == "context" and confidence >= least}


def personal_instances(text, base):
    """(start, end, context, shape, seed) of base spans (start, end) and of what else looks like an identifier, by plain rules."""
    edge, space = "\"'()[]{}<>,;:!?.|", " \t\n\x0b\x0c\r"
    words, k = [], 0  # (start, text) of everything between white space
    while k < len(text):
        if text[k] in space:
            k += 1
            continue
        end = k
        while end < len(text) and text[end] not in space:
            end += 1
        words.append((k, text[k:end]))
        k = end
    found, run = [], []
    for at, word in [*words, (len(text) + 9, "")]:
        left, core = len(word) - len(word.lstrip(edge)), word.strip(edge)
        start, end = at + left, at + left + len(core)
        taken = any(a < end and start < b for a, b in base)
        number = not taken and core[:1] in set("+(0123456789") and re.fullmatch(r"[+(]*[0-9][0-9().+/-]*", core)
        if number:
            start -= word[:left].endswith("(")
            end += word[left + len(core) :].startswith(")")
        joins = number and run and at == start == run[-1][1] + 1
        if run and not joins:
            if sum(n for *_, n in run) >= 6:
                found.append((run[0][0], run[-1][1]))
            run = []
        n = sum(c.isdigit() for c in core)
        if number:
            run.append((start, end, n))
        elif not taken and re.search("[0-9@]", word) and (n >= 6 or "@" in core):
            found.append((start, end))

    def context(start):
        before = [w for w in (x.strip(edge) for x in re.split(f"[{space}]+", text[:start])) if w]
        return " ".join(before[-2:]).lower()

    shape = lambda s: re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", s))
    return [(a, b, context(a), shape(text[a:b]), seed) for spans, seed in ((base, True), (found, False)) for a, b in spans]
