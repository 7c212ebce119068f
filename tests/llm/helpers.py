"""Brute-force versions of the contracts, and documents with awkward cases."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, n_words string, component_id string, g long"


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls, empty and short texts, copies, near copies, shared passages, a long text, clashing columns."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)] + ["the", "of", "é", "Über", "x-1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "one", "one two three four", "ONE two three four", "a b c d e", "a\x0bb c\x0cd e", "the " * 40]
    base = say(120)
    texts += [base, base, base + " tail"]
    for _ in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = say(60)
    texts += [f"{say(30)}\n{passage}\n{say(40)}" for _ in range(5)]
    texts += [passage, say(20_000), "same " * 13, "same " * 30, f"{say(3)} {'same ' * 14}"]
    texts += [say(rng.randrange(1, 80)) for _ in range(60)]
    texts += [texts[-1].upper(), texts[-2].replace(" ", "\n")]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x", None, 7) for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[20], (None, base, "x", None, 7), (None, None, None, None, None)]


def components(rows: list[tuple], size: int = 5, percent: int = 75) -> list[tuple]:
    """(id, n_shingles, component_id) of each row, as sorted tuples."""
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return sorted(((r[0], len(s), least.get(find(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def without_repeats(rows: list[tuple], size: int = 13) -> list[tuple]:
    """(id, n_words, n_removed, kept words) of each row, as sorted tuples."""
    first = {}
    last = 2**63
    words = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, last), last if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (last if r[0] is None else r[0]):
                gone[k : k + size] = [True] * size
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def base_rules(text: str | None) -> tuple:
    w = WORD.findall(text or "")
    seen, lines = {}, [x for x in (text or "").split("\n") if WORD.search(x)]
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    at = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def hits(text: str | None, items: list[tuple]) -> tuple:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = split(text), set(), set()
    for item, item_text in items:
        v = split(item_text)
        size = min(13, len(v))
        windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1) if v else ():
            if tuple(w[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)
