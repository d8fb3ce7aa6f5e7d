"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    repeat = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat),
        "base_failed": n < 20 or 100 * len(repeat) > 30 * n,
    }


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def chat(turns):
    """n_turns and digests of the (role, text) of one conversation."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), SHA("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), SHA(loss)


def page(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def secrets(text):
    text = text or ""
    kinds = (
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    found = [
        (m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(kinds)
        for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least
    ]
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def jaccard_groups(docs, size=4, share=85):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, text in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, size=50):
    """doc_id -> (bytes, removed, spans, digest of what is left)."""
    first = {}
    texts = {i: (t or "").encode() for i, t in docs}
    for i in sorted(texts):
        for j in range(len(texts[i]) - size + 1):
            first.setdefault(texts[i][j : j + size], i)
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if first[b[j : j + size]] < i:
                gone[j : j + size] = b"\1" * size
        spans = len(re.findall(b"\1+", gone))
        out[i] = (len(b), sum(gone), spans, SHA(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def personal(text, least=0.5):
    """(base spans, all spans) of the personal data in a text, as (start, kind number, end)."""
    from kindred.llm.personal import IBAN_LENGTHS, KINDS, SCORES

    text = text or ""
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "ssn": r"[0-9]+(?:[\x20./-][0-9]+)+", "national": r"[0-9]+(?:[\x20./-][0-9]+)+",
    }

    def luhn(number):
        total = 0
        for i, d in enumerate(map(int, reversed(number))):
            d = d * 2 if i % 2 else d
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    base, added = [], []
    for k, kind in enumerate(KINDS):
        found = list(re.finditer(forms[kind], text))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()][-40:]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][:20]
            s, end = m[0], m.end()
            number = re.sub("[^0-9]", "", s)
            free = not re.search(r"[A-Za-z0-9+]\Z", before) and not re.match("[A-Za-z0-9]", after)
            if kind == "ip":
                good = all(int(x) <= 255 for x in s.split("."))
            elif kind == "card":
                good = 14 <= len(number) <= 19 and luhn(number)
            elif kind == "phone":
                good = 10 <= len(number) <= 15
            elif kind == "iban":
                size, places = IBAN_LENGTHS.get(s[:2], 99), [j for j, c in enumerate(s) if c != " "]
                good = len(places) >= size
                if good:
                    end = m.start() + places[size - 1] + 1
                    account = text[m.start() : end].replace(" ", "")
                    good = int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
                    good = good and not re.search(r"[A-Za-z0-9]\Z", before) and not re.match("[A-Za-z0-9]", s[end - m.start() :] + after)
            elif kind == "ssn":
                good = free and re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", s) and not re.match("000|666|9", s) and "-00-" not in s and not s.endswith("-0000")
            elif kind == "national":
                parts = re.split(r"[\x20./-]", s)
                good = free and 2 <= len(parts) <= 5 and all(2 <= len(p) <= 4 for p in parts) and 7 <= len(number) <= 12 and not re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", s)
            else:
                good = True
            if good and k < 4:
                base.append((m.start(), k, end))
            elif good:
                alone, words, against = SCORES[kind]
                near = f"{before} | {after}".translate({c: c + 32 for c in range(65, 91)})
                said = lambda w: re.search(rf"(?:\A|[^a-z0-9])(?:{w})(?:[^a-z0-9]|\Z)", near) is not None  # noqa: B023, E731
                if round(min(1, max(0, alone + 0.4 * said(words) - 0.3 * said(against))), 3) >= least:
                    added.append((m.start(), k, end))
    base.sort()
    added = [a for a in added if not any(a[0] < b[2] and b[0] < a[2] for b in base)]
    return base, sorted(base + added)
