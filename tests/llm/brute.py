"""Plain Python versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c)
        total += (2 * x - 9 if x > 4 else 2 * x) if k % 2 else x
    return total % 10 == 0


def private(text):
    text = text or ""
    bare = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(bare(m[0])) <= 19 and luhn(bare(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(bare(m[0])) <= 15],
    }


def alignment(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            above = row[j + 1]
            row[j + 1] = diagonal + 1 if x == y else max(above, row[j])
            diagonal = above
    return row[-1]
