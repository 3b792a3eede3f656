"""Plain-Python versions of the contracts, for small tables."""

import collections
import hashlib
import re
import zlib
from functools import lru_cache

SPACE_WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXT_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, k):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(rows, k=3, num=9, den=10):
    """rows: (doc_id, text); (doc_id, n_shingles, component_id) per row."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posting[x].append(i)
    for i, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in posting[x] if j > i)
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return sorted(((d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def contamination(rows, items, window=13):
    wins = collections.defaultdict(set)
    for item, text in items:
        w = TEXT_WORD.findall(lower(text))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[i:i + window])].add(item)
    sizes = sorted({len(x) for x in wins})
    out = []
    for d, text in rows:
        w = TEXT_WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                owners = wins.get(tuple(w[i:i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def quality_base(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


BASE_KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
     lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secret_base(text):
    """Base spans as (start, kind number, end)."""
    return sorted((m.start(), n, m.end()) for n, (_, p, ok) in enumerate(BASE_KINDS) for m in p.finditer(text or "") if ok(m))


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def repeated_bytes(rows, length=200):
    """Per row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        reach = 0
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                for j in range(max(i, reach), i + length):
                    gone[j] = 1
                reach = i + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(kept)))
    return sorted(out, key=repr)


VISIBLE = re.compile("[^\x20\x09-\x0d]")

def cheapest(kinds):
    """kinds: (role, text, fault) -> (cost, audit, repaired lines) by a search over all edits."""
    best = {}
    def nxt(state, c):  # states: '', 's', 'u', 'a'
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, c))
    @lru_cache(None)
    def go(i, state, inserted):
        """(cost, audit, lines) of the rest"""
        out = []
        if i == len(kinds):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            role, text, fault = kinds[i]
            c, a, l = go(i + 1, state, 0)
            out.append((c + 2, "D" + a, l))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                s = nxt(state, role[:1])
                if s:
                    c, a, l = go(i + 1, s, 0)
                    out.append((c + extra, "K" + a, (f"{role}:{text}",) + l))
                for r in ("user", "assistant"):
                    s = nxt(state, r[0])
                    if s:
                        c, a, l = go(i + 1, s, 0)
                        out.append((c + 1 + extra, "R" + a, (f"{r}:{text}",) + l))
        if inserted < 4:
            for r in ("user", "assistant"):
                s = nxt(state, r[0])
                if s:
                    c, a, l = go(i, s, inserted + 1)
                    out.append((c + 5, "I" + a, (f"{r}:",) + l))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())
    return go(0, "", 0)

def conversation_repair(rows):
    """rows: (conv_id, turn, role, text) -> rows of the contract."""
    convs = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hurt = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
        role = "user" if hurt == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if hurt == 0 else 2 if hurt == 3 else 1))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        seen, kinds = set(), []
        for _, role, text in turns:
            words = VISIBLE.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append((role, text, fault))
        count = lambda f: sum(k[2] == f for k in kinds)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit, lines = cheapest(tuple(kinds))
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def merkle_manifest(docs, fanout=16):
    """docs: (doc_id, source, lang, n_chars, text) -> the rows of the contract."""
    def frame(v): return "-" if v is None else f"{len(str(v).encode())}:{v}"
    def leaf(row): return sha("".join(map(frame, row)))
    def fold_up(nodes):
        """(root, siblings per node: list of (left, right) level by level)"""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i:i + fanout])) for i in range(0, len(last), fanout)])
        paths = []
        for i in range(len(nodes)):
            path, at = [], i
            for lv in levels[:-1]:
                run = at // fanout * fanout
                path.append(("".join(lv[run:at]), "".join(lv[at + 1:run + fanout])))
                at //= fanout
            paths.append(path)
        return levels[-1][0], paths
    groups = {}
    for row in docs:
        groups.setdefault(row[1], []).append((row[0], leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = fold_up([r[1] for r in groups[s]])
    if not names:
        return []
    root, upper = fold_up([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper):
        for (doc_id, own, row), path in zip(groups[s], trees[s][1]):
            path = path + up
            h = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and row[4] is not None:
                h = leaf((*row[:4], lower(row[4])))
            for left, right in path:
                h = sha(left + h + right)
            out.append((doc_id, own, trees[s][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)
