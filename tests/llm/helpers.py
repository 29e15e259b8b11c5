"""Small documents with all kinds of trouble, and plain Python versions of what operators compute."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(source, words, vocabulary=400):
    return " ".join("".join(source.choice("etaoinshrdlu") for _ in range(1 + source.randrange(vocabulary) % 7)) for _ in range(words))


def row(doc_id, text, lang="en"):
    return doc_id, text, lang, "s", None if text is None else len(text)


def troubled(seed=1):
    """Copies, near copies, shared passages, nulls, empty and very long texts, odd characters."""
    source = random.Random(seed)
    passage = prose(source, 30)
    base = prose(source, 80)
    rows = [row(i, prose(source, source.randrange(1, 120))) for i in range(40)]
    rows += [row(100 + i, base) for i in range(6)]
    for i in range(25):
        words = base.split()
        for _ in range(i % 5):
            words[source.randrange(len(words))] = "changed%d" % i
        rows.append(row(200 + i, " ".join(words)))
    rows += [row(300 + i, f"{prose(source, 20)} {passage} {prose(source, 25)}") for i in range(12)]
    rows += [
        row(400, None), row(401, ""), row(402, " \n\t "), row(403, "Ärger über ümläute, été à Noël. " * 9), row(404, "一二三 🎉🎉 四五 " * 30),
        row(405, "x"), row(406, "A b C"), row(407, "a B c"), row(408, "same same " * 300), row(409, prose(source, 9000)),
        row(410, "no" * 4000), row(411, "....!!!! ?? 12 34"), row(412, "nul\x00byte and \x7f control " * 4),
    ]
    return rows


def words_of(text, lower=True):
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)
