"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

LONG = " ".join(f"wort{i % 997}x{i}" for i in range(30_000))
SECRET = "client_id: myapp77 and zzqJalrXUtnFEMIK7MDENGbPxRfiCYEX1 at https://x.example.com/a end of it all"
# doc_id, text, lang, source: absent values, empty and long texts, repeated rows and ids, ties.
EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", None, None),
    (None, "token=abcdefghijklmnop and some more words to fill a line of text here", "en", "a"),
    (None, None, None, None),
    (6, "ONE two three four five six seven eight nine ten eleven twelve", "de", "b"),
    (7, LONG, "de", "b"),
    (8, LONG + " und ein Ende", "de", "b"),
    (9, "é" * 5000 + " <|endoftext|> \x1c x y \U0001f600 İstanbul.", "fr", "b"),
    (10, "same line\nsame line\n\nsame line\n" * 40, "fr", "b"),
    (11, SECRET, "en", "a"),
    (11, "another text under the same id, long enough to pass the rules for words", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def statistics(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": sum(c.isupper() and len(c) == 1 for c in text),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def _quantile(values: np.ndarray, share: float) -> float:
    return float(np.quantile(values, share, method="inverted_cdf")) if len(values) else 0.0


def robust_distances(rows: list[dict], groups: list[str], least: list[float], share=0.75, steps=3, pseudo=30.0, consistency=1.41) -> np.ndarray:
    """Squared robust distances; the same deterministic starts and steps in numpy."""
    x = np.array([[
        math.log(1 + r["word_chars"] / max(r["n_words"], 1)), math.sqrt(r["n_symbols"] / max(r["n_words"], 1)),
        math.sqrt(r["n_dup_lines"] / max(r["n_lines"], 1)), math.sqrt(r["n_repeat_words"] / max(r["n_words"], 1)),
        math.sqrt(r["n_capitals"] / max(r["word_chars"], 1)),
    ] for r in rows])
    least = np.array(least)
    failed = np.array([r["base_failed"] for r in rows])
    quartiles = lambda v: np.array([[_quantile(v[:, k], q) for q in (.25, .5, .75)] for k in range(x.shape[1])])
    whole = quartiles(x)
    centre, spread = whole[:, 1], np.maximum(least, (whole[:, 2] - whole[:, 0]) / 1.349) ** 2
    out = np.zeros(len(rows))
    for group in sorted(set(groups)):
        own = np.array([g == group for g in groups])
        v = x[own & ~failed]
        if not len(v):
            continue
        q = quartiles(v)
        z = np.abs(v - q[:, 1]) / np.maximum((q[:, 2] - q[:, 0]) / 1.349, least)
        best = None
        for d2 in ((z ** 2).sum(axis=1), z.max(axis=1)):
            part = 0.5
            for _ in range(steps + 1):
                inside = v[d2 <= _quantile(d2, part)]
                n = len(inside)
                mean = (inside.sum(axis=0) + pseudo * centre) / (n + pseudo)
                scatter = (inside - inside.mean(axis=0)).T @ (inside - inside.mean(axis=0))
                cov = (scatter * consistency + pseudo * np.diag(spread)) / (n + pseudo) + np.diag(least ** 2)
                inverse = np.linalg.inv(cov)
                d2 = np.einsum("ij,jk,ik->i", v - mean, inverse, v - mean)
                part = share
            found = (np.linalg.slogdet(cov)[1], mean, inverse)
            best = found if best is None or found[0] < best[0] - 1e-12 else best
        out[own] = np.einsum("ij,jk,ik->i", x[own] - best[1], best[2], x[own] - best[1])
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    """doc_id -> least doc_id of its component, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    low, high = sorted((find(i), find(j)))
                    parent[high] = low
    return {i: find(i) for i in parent}


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


# Weak parts in patterns of their own, for texts of any make.
WEAK = [
    ("id", r"(?i)(?a:\b)(?:user|login|(?:client|access|account|user|key)[_-]?(?:name|id))[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9@._-]{3,}"),
    ("key", r"(?<![0-9A-Za-z_+/=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![0-9A-Za-z_+/=-])"),
    ("host", r"(?i)(?a:\b)(?:[a-z][a-z0-9+]{1,15}://[^ \t-\r\"'<>]+|(?:server|endpoint|host)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9.:_-]{3,})"),
]


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def all_spans(text: str | None, weak: list[tuple[str, str]], reach: int = 256) -> list[tuple[int, int, str, int]]:
    """Base spans and the weak parts with a complement near them in their paragraph, every pair looked at."""
    text = text or ""
    base = base_spans(text)
    parts = [(m.start(), 3 + k, kind, m.end()) for k, (kind, pattern) in enumerate(weak) for m in re.finditer(pattern, text)]
    parts = [p for p in parts if all(b[3] <= p[0] or p[3] <= b[0] for b in base)]
    role = lambda s: "id" if s[2] in ("id", "access") else "host" if s[2] == "host" else "key"
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda s: sum(b < s[0] for b in breaks)
    linked = [p for p in parts if any(
        role(p) != role(r) and scope(p) == scope(r) and (r[3] <= p[0] or p[3] <= r[0]) and r[0] < p[3] + reach and p[0] < r[3] + reach for r in base + parts
    )]
    return sorted(base + linked)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def checksum(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
