"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def byte_repeats(rows, length):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if count[b[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        kept = bytes(y for y, z in zip(b, gone) if not z)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def word_repeats(rows, length):
    seen, out = set(), []
    for i, text in rows:
        w = blank_words(text)
        gone = [0] * len(w)
        for x in range(len(w) - length + 1):
            window = tuple(w[x : x + length])
            if window in seen:
                gone[x : x + length] = [1] * length
            seen.add(window)
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g))))
    return out


def near_duplicates(rows, width, percent):
    """Per row: size of its set and the number of the row that leads its component."""
    sets = []
    for _, text in rows:
        w = blank_words((text or "").translate(SMALL))
        sets.append({tuple(w[x : x + width]) for x in range(max(len(w) - width, 0) + 1)} if w else set())
    lead = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y) and lead[a] != lead[b]:
                    lead[a] = lead[b] = min(lead[a], lead[b])
                    changed = True
    return [(len(s), l) for s, l in zip(sets, lead)]


def overlaps(rows, items, length):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(length, len(w))
        for x in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[x : x + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w = alnum_words(text)
        hit, found = [0] * len(w), set()
        for n in sizes:
            for x in range(len(w) - n + 1):
                who = windows.get(tuple(w[x : x + n]))
                if who:
                    hit[x : x + n] = [1] * n
                    found |= who
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), sum(hit) > 0))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        double = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_entities(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if passes(kind, m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def rules(text):
    w = blank_words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, again = Counter(windows), [0] * len(w)
    for i, x in enumerate(windows):
        if count[x] > 1:
            again[i : i + 3] = [1] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if blank_words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, sum(again), len(w) < 50 or 100 * sum(again) > 50 * len(w)


def phrases(text):
    w, found = alnum_words(text), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({l for _, l in found}))


def tokens(rows, tokenizer, end_id):
    at, out = 0, []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


def runs(words, min_length, exponent):
    """(start, length, period) of every run, by start and period: each period is tried on its own."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    return [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in found)]


def planted_words(doc_id, text):
    words = blank_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def alignments(rows, a_path, b_path):
    """Per row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups as text), by cutting at common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(a_path)
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=b_path)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    a_bytes = lambda i: bytes(byte[c] for c in one.id_to_token(i))
    b_bytes = lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("\u2581", " ").encode()
    found, count = [], Counter()
    for i, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        sa, sb = [a_bytes(x) for x in a], [b_bytes(x) for x in b]
        if text and not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            a, b, sa, sb = [], [], [], []
        groups, x, y = [], 0, 0
        while x < len(a):
            ga, gb, ea, eb = [a[x]], [b[y]], len(sa[x]), len(sb[y])
            x, y = x + 1, y + 1
            while ea != eb:
                if ea < eb:
                    ga.append(a[x]); ea += len(sa[x]); x += 1
                else:
                    gb.append(b[y]); eb += len(sb[y]); y += 1
            groups.append((ga, gb))
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        count.update(set(links))
        found.append((i, len(a), len(b), groups, links))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    return [(i, n, m, len(groups), len(links), sum(count[l] == best[l[0]] for l in links), sum(count[l] for l in links),
             ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)) for i, n, m, groups, links in found]


def exact_duplicates(rows):
    """Per row of a list in the order of id and text: (id, id of the last row with its text, their number, whether it is the last, digest)."""
    texts = [(text or "").translate(SMALL) for _, text in rows]
    last, count = {t: i for i, t in enumerate(texts)}, Counter(texts)
    return [(rows[i][0], rows[last[t]][0], count[t], last[t] == i, sha(t)) for i, t in enumerate(texts)]
