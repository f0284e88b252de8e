"""Plain single-process versions of the operators, to compare small results with."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict


def op3(rows: list[tuple[int | None, str | None]], length: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); rows of one doc_id count as one document's versions."""
    last = (1 << 63) - 1
    order = sorted(range(len(rows)), key=lambda i: last if rows[i][0] is None else rows[i][0])
    first: dict[bytes, tuple[int, int]] = {}
    texts = [(t or "").encode() for _, t in rows]
    key = lambda i: last if rows[i][0] is None else rows[i][0]
    for i in order:
        t = texts[i]
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, (last, len(t))), (key(i), p))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        t = texts[i]
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (key(i), p):
                cut[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cut, strict=True) if not c)
        spans = sum(1 for j, c in enumerate(cut) if c and (j == 0 or not cut[j - 1]))
        out.append((doc_id, len(t), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op6(rows: list[tuple[int | None, str | None]], k: int = 13) -> dict[int, list[bool]]:
    """Which words of each row go."""
    last = (1 << 63) - 1
    words = [(t or "").encode().split() for _, t in rows]
    key = [last if i is None else i for i, _ in rows]
    first: dict[tuple, int] = {}
    for w, i in zip(words, key, strict=True):
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, last), i)
    out = {}
    for n, (w, i) in enumerate(zip(words, key, strict=True)):
        cut = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                cut[p : p + k] = [True] * k
        out[n] = cut
    return out


def links(rows: list[tuple[int | None, str | None]], k: int, percent: int) -> dict[int, int]:
    """Smallest linked doc_id of each doc_id."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").translate(low).encode().split()
        if i is not None and w:
            sets.append((i, {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))}))
    up = {i: i for i, _ in rows if i is not None}

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return {i: top(i) for i in up}


SPACE = re.compile("[ \\t-\\r]+")


def quality(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of rows (doc_id, text, lang, source)."""
    spread, prior, scale = 8, 100, 100_000
    found = []
    for doc_id, text, lang, source in rows:
        text = text or ""
        w = [x for x in SPACE.split(text) if x]
        lines = [x for x in text.split("\n") if SPACE.sub("", x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(windows)
        again = {i + j for i, g in enumerate(windows) if times[g] > 1 for j in range(5)}
        chars, symbols, dup = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
        echoes = sum(a == b for a, b in itertools.pairwise(w))
        bad = len(w) < 10 or 100 * len(again) > 20 * len(w)
        rate = lambda a, b, k=scale: k * a // b if b else 0
        found.append({"id": doc_id, "lang": lang, "source": source, "n": len(w), "chars": chars, "symbols": symbols, "dup": dup, "again": len(again), "bad": bad, "symbol": rate(symbols, chars), "line": rate(dup, len(w)), "echo": rate(echoes, len(w)), "len": rate(chars, len(w), 100)})

    def own(group: list[dict]) -> tuple[int, list[float]]:
        def q(c: str, p: float) -> float:
            s = sorted(x[c] for x in group)
            return float(s[max(0, math.ceil(p * len(s)) - 1)])

        high = [q(c, 0.75) + spread * max(q(c, 0.75) - q(c, 0.5), scale / q(base, 0.5)) for c, base in (("symbol", "chars"), ("line", "n"), ("echo", "n"))]
        error = q("len", 0.5) / (2 * math.sqrt(q("n", 0.5)))
        return len(group), [*high, q("len", 0.75) + spread * max(q("len", 0.75) - q("len", 0.5), error), q("len", 0.25) - spread * max(q("len", 0.5) - q("len", 0.25), error)]

    good = [x for x in found if not x["bad"]]
    by_lang, by_both = defaultdict(list), defaultdict(list)
    for x in good:
        by_lang[x["lang"]].append(x)
        by_both[x["lang"], x["source"]].append(x)
    blend = lambda a, wider: [(a[0] * x + prior * y) / (a[0] + prior) for x, y in zip(a[1], wider, strict=True)]
    every = own(good)[1] if good else []
    lang = {k: blend(own(g), every) for k, g in by_lang.items()}
    both = {k: blend(own(g), lang[k[0]]) for k, g in by_both.items()}
    out = []
    for x in found:
        kept = False
        if not x["bad"]:
            a, b, c, hi, lo = both[x["lang"], x["source"]]
            kept = x["symbol"] <= a and x["line"] <= b and x["echo"] <= c and lo <= x["len"] <= hi
        out.append((x["id"], x["n"], x["chars"], x["symbols"], x["dup"], x["again"], x["bad"], kept))
    return out


def mixed(rows: list[tuple]) -> dict[int, int]:
    """How often each doc_id is taken, of rows (doc_id, text, source) with distinct ids."""
    size = {i: len([x for x in SPACE.split(t or "") if x]) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * total[s] <= share * weight[s]}
        target |= {s: float(3 * total[s]) for s in full} if full else {s: share * weight[s] for s in open_}
        open_ -= full or open_
    out = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        own = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, _, x in rows if x == s)
        for _, i in own:
            more = 2 * upto + size[i] < 2 * rest
            upto += size[i]
            out[i] = min(3, whole + more)
    return out


def _mix(h: int) -> int:
    full = (1 << 64) - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & full
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & full
    return h ^ h >> 31


def spans(text: str, model, switch: float) -> list[tuple[int, int, str]]:
    """Runs of words of one language in the best of all labellings."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
    n = len(model.languages)
    scores = []
    for a, b in words:
        w = b" " + raw[a:b].lower() + b" "
        own = [0.0] * n
        for k in (2, 3, 4):
            for i in range(len(w) - k + 1):
                bucket = _mix((int.from_bytes(w[i : i + k], "big") * 8 + k) % (1 << 64)) % (1 << 16)
                own = [x + float(model.table[bucket, j]) for j, x in enumerate(own)]
        scores.append([x + float(model.narrow[_latin(), j]) for j, x in enumerate(own)])
    if not words:
        return []
    best = max(itertools.product(range(n), repeat=len(words)), key=lambda p: float(model.prior[p[0]]) + sum(s[x] for s, x in zip(scores, p, strict=True)) - switch * sum(x != y for x, y in itertools.pairwise(p)))
    out: list[tuple[int, int, str]] = []
    for (a, b), x in zip(words, best, strict=True):
        lang = model.languages[x]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], b, lang)
        else:
            out.append((a, b, lang))
    return out


def _latin() -> int:
    from tessella.llm import language

    return language._NAMES.index("Latin")


def kernel_triples(symbols: list[str], marks: list[int], span: int, letter: float, mark: float) -> dict[tuple, list[float]]:
    """The weights of every occurrence of each triple of symbols. marks: characters that are no letter before each symbol."""
    out: dict[tuple, list[float]] = defaultdict(list)
    for i, j, k in itertools.combinations(range(len(symbols)), 3):
        if k - i < span:
            out[symbols[i], symbols[j], symbols[k]].append(letter ** (k - i - 2) * mark ** sum(marks[i + 1 : k + 1]))
    return out


def kernel(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]], *decay) -> float:
    """The normalised kernel of two strings, each its symbols and marks."""
    x, y = kernel_triples(*a, *decay), kernel_triples(*b, *decay)
    norm = lambda t: math.sqrt(sum(w * w for ws in t.values() for w in ws)) or 1.0
    return sum(sum(ws) * sum(y[t]) for t, ws in x.items() if t in y) / norm(x) / norm(y)


def repair(rows: list[tuple[str, str]], runs: int = 2) -> tuple[int, str, str]:
    """(cost, audit, repaired text) of the cheapest edits of the rows (role, text) of one conversation, trying all."""
    seen, faults = set(), []
    for r in rows:
        text = r[1].strip(" \t\n\v\f\r")
        faults.append("delete" if not text or r in seen else "cut" if text[-1] not in ".!?" else "ok")
        seen.add(r)
    fits = re.compile("(s?(ua)+)?")
    best = None
    inserts = [p for n in range(runs + 1) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = [["D"] if f == "delete" else ["D", "K", "user", "assistant"] for f in faults]
    for edits in itertools.product(*choices):
        base = sum(4 if e == "D" else (0 if e == "K" else 3) + 3 * (f == "cut") for e, f in zip(edits, faults, strict=True))
        if best and base > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for n, gap in enumerate(gaps):
                audit += "I" * len(gap)
                out += [(role, "") for role in gap]
                if n < len(rows):
                    audit += edits[n] if edits[n] in "DK" else "R"
                    if edits[n] != "D":
                        out.append((rows[n][0] if edits[n] == "K" else edits[n], rows[n][1]))
            found = (cost, audit, "\n".join(map(":".join, out)))
            if fits.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or found < best):
                best = found
    return best
