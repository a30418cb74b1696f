"""A small independent model of the secret scan in plain Python, for comparison."""

import math
import re
from collections import Counter

from lumenaudit import catalog as C


def entropy(v):
    n = len(v)
    return sum(-(k / n) * math.log2(k / n) for k in Counter(v).values()) if n else 0.0


def line_around(text, m):
    """Stripped line(s) of a match, at most 160 characters."""
    first = text[:m.start()].split("\n")[-1]
    rest = text[m.end():]
    tail = rest.split("\n")[0] if "\n" in rest else rest[:80]
    return (first + m.group(0) + tail).strip()[:160]


def matches(text):
    for ord_, d in enumerate(C.DETECTORS):
        for i, m in enumerate(re.finditer(d.pattern, text)):
            yield ord_, i, m.group(d.group), line_around(text, m)


def real(category, raw, url):
    v = raw.strip()
    low = v.lower()
    if not v or low in C.PLACEHOLDER_VALUES or [p for p in C.PLACEHOLDER_PARTS if p in low]:
        return False
    if category == "emails":
        asset = any(url.lower().endswith(e) for e in C.ASSET_URL_SUFFIXES)
        return not (asset or low.split("@")[-1].split(".")[-1] in C.FILE_LIKE_TLDS
                    or any(x in low for x in C.RETINA_MARKS))
    if category == "passwords":
        return 3 <= len(v) <= 64
    if category in C.ENTROPY_CATEGORIES:
        return any(low.startswith(p) for p in C.KNOWN_PREFIXES) or (len(v) >= 8 and entropy(v) >= 2.5)
    return True
