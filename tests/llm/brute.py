"""Plain versions of the operators, one document at a time, to compare their results with."""

import datetime
import hashlib
import math
import re

import numpy as np
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, n: int) -> list[bytes]:
    words = WORDS.findall((text or "").encode().translate(LOWER))
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def simhash(text: str | None) -> int:
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n: int, linked) -> list[int]:
    """The least index reachable from each, by links that linked(i, j) tells."""
    root = list(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if root[i] != root[j] and linked(i, j):
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if r == b else r for r in root]
    return root


def near(a: set, b: set, least: float = 0.8) -> bool:
    return a == b or bool(a and b) and len(a & b) >= least * len(a | b) - 1e-9


def word_log(word: str, pieces: dict[str, int], prob: np.ndarray, unknown: float) -> np.ndarray:
    """log of the sum over all segmentations, for each language."""
    out = np.zeros(prob.shape[1])
    w = "▁" + word
    for part in [w[i : i + 40] for i in range(0, len(w), 40)]:
        alpha = [np.ones(prob.shape[1])]
        for end in range(1, len(part) + 1):
            total = alpha[end - 1] * unknown
            for start in range(end):
                if (k := pieces.get(part[start:end])) is not None:
                    total = total + alpha[start] * prob[k]
            alpha.append(total)
        out += np.log(alpha[-1])
    return out


def language(text: str | None, langs: list[str], pieces: dict[str, int], prob: np.ndarray, unknown: float, seen: dict) -> tuple[str, float]:
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    logs = np.zeros(len(langs))
    for w in text.split():
        if w not in seen:
            seen[w] = word_log(w, pieces, prob, unknown)
        logs = logs + seen[w]
    return langs[int(logs.argmax())], float(1 / np.exp(logs - logs.max()).sum())


def cut(bodies: list[bytes], width: int = 200) -> list[np.ndarray]:
    """For each body, which bytes go."""
    count: dict[bytes, int] = {}
    for b in bodies:
        for i in range(len(b) - width + 1):
            count[b[i : i + width]] = count.get(b[i : i + width], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


# ---- personal data: the same rules, in Python


def permuted(index: int, a: int, b: int, kind: str, key: str) -> int:
    left, right = divmod(index, b)
    for i in range(8):
        own = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{key}:{kind}:{i}:{own}".encode()).hexdigest()[:13], 16)
        left, right = ((left + f) % a, right) if i % 2 == 0 else (left, (right + f) % b)
    return left * b + right


def refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left, "") if c in "0123456789" else c for c in shape)


def luhn(d: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    k = len(d) - 2
    half = k // 2
    core = d[0] + str(permuted(int(d[1:-1]), 10 ** (k - half), 10**half, "card", key)).zfill(k)
    return refill(m, core + str((10 - luhn(core + "0")) % 10))


def _iban(m, key):
    flat = m.replace(" ", "")
    body = flat[4:]
    d = re.sub("[^0-9]", "", body)
    if len(flat) < 15 or len(d) < 6 or mod97(body + flat[:4]) != 1:
        return m
    k = min(len(d), 16)
    half = k // 2
    digits = d[: len(d) - k] + str(permuted(int(d[-k:]), 10 ** (k - half), 10**half, "iban", key)).zfill(k)
    return refill(m, str(98 - mod97(refill(body, digits) + flat[:2] + "00")).zfill(2) + digits)


def _ip(m, key):
    n = 0
    for o in m.split("."):
        n = n * 256 + int(o)
    n = permuted(n, 65536, 65536, "ip", key)
    return ".".join(str(n >> 8 * i & 255) for i in (3, 2, 1, 0))


def _ssn(m, key):
    d = re.sub("[^0-9]", "", m)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    n = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn", key)
    head, serial = divmod(n, 9999)
    area, group = divmod(head, 99)
    area += 1
    area += area >= 666
    return refill(m, f"{area:03}{group + 1:02}{serial + 1:04}")


def _phone(m, key):
    d = re.sub("[^0-9]", "", m)
    return refill(m, ("1" if len(d) == 11 else "") + str(permuted(int(d[-10:]), 100000, 100000, "phone", key)).zfill(10))


def _date(m, key):
    p = re.split("[-./]", m)
    iso = bool(re.match("[0-9]{4}-", m))
    y, mo, d = p if iso else p[::-1]
    first = datetime.date(1900, 1, 1)
    try:
        n = (datetime.date(int(y), int(mo), int(d)) - first).days
    except ValueError:
        return m
    if n >= 270 * 271:
        return m
    new = first + datetime.timedelta(permuted(n, 270, 271, "date", key))
    if iso:
        return new.isoformat()
    sep, short = re.search("[-./]", m)[0], lambda v, was: str(v) if len(was) == 1 else f"{v:02}"
    return short(new.day, d) + sep + short(new.month, mo) + sep + str(new.year)


def _email(m, key):
    return "user-" + hashlib.sha256(f"{key}:email:{m.lower()}".encode()).hexdigest()[:12] + "@mail.invalid"


def _secret(m, key):
    head = (re.match(r"(?i:[a-z_\-]+[\"']?\s*[=:]\s*[\"']?)", m) or [""])[0]
    tail = re.search(r"[\"']?$", m)[0]
    value = m[len(head) : len(m) - len(tail)]
    return head + "[secret-" + hashlib.sha256(f"{key}:secret:{value}".encode()).hexdigest()[:10] + "]" + tail


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def pseudonyms(text: str, pii, key: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with pseudonyms, and (kind, value, pseudonym) of what changed; patterns are those of the operator."""
    flags = re.ASCII
    kind_of = lambda m: next((k for k, p in pii.PATTERNS.items() if re.search(f"^(?:{p})$", m, flags)), None)
    out, found, at = [], [], 0

    def within(m: str) -> None:
        pos, done = 0, 0
        for word in re.finditer(r"(?<![A-Z0-9])[A-Z0-9]+", m):
            if word.start() < pos:
                continue
            rest = m[word.start() : word.start() + 64]
            options = [("iban", pii._FIXED), ("iban", pii.PATTERNS["iban"]), *[(k, pii.PATTERNS[k]) for k in ("ssn", "date", "phone")], *[("card", rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}{pii.END}") for n in range(19, 12, -1)]]
            for kind, pattern in options:
                got = re.match(f"(?:{pattern})", rest, flags)
                if got and (new := MAKERS[kind](got[0], key)) != got[0]:
                    out.extend([m[done : word.start()], new])
                    found.append((kind, got[0], new))
                    pos = done = word.start() + len(got[0])
                    break
        out.append(m[done:])

    for hit in re.finditer(pii.ANY, text, flags):
        out.append(text[at : hit.start()])
        at = hit.end()
        m, kind = hit[0], kind_of(hit[0])
        new = MAKERS[kind](m, key) if kind else m
        if new != m:
            out.append(new)
            found.append((kind, m, new))
        elif kind in (None, "iban", "card"):
            within(m)
        else:
            out.append(m)
    return "".join(out) + text[at:], found


def dct_hash(image: np.ndarray) -> int:
    """The bits of the lowest 8 x 8 cosine frequencies of a 32 x 32 picture of means, by their definition."""
    h, w = image.shape
    edges = lambda n, i: (i * n // 32, (i + 1) * n // 32)
    small = np.zeros((32, 32))
    for y in range(32):
        a, b = edges(h, y) if h >= 32 else (y * h // 32, y * h // 32 + 1)
        for x in range(32):
            c, d = edges(w, x)
            small[y, x] = image[a:b, c:d].mean()
    wave = lambda k, i: math.cos(math.pi * (2 * i + 1) * k / 64)
    low = [round(sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return sum(1 << (63 - i) for i in range(1, 64) if low[i] > middle)
