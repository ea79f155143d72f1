"""Small tables and brute force that several tests share."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, texts, langs=None, sources=None, start=1):
    rows = [(start + k, t, (langs or ["en"])[k % len(langs or ["en"])], (sources or ["a"])[k % len(sources or ["a"])], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentence(rng: random.Random, n, vocabulary=400):
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


def components(nodes, linked):
    """Smallest node that links reach, for each node."""
    found = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in linked:
            low = min(found[a], found[b])
            for n in (a, b):
                if found[n] != low:
                    found[n], change = low, True
    return found
