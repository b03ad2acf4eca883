"""Odd inputs and small helpers that the tests of this folder share."""

import random
import re

DOC_COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
               "id long, th long, fp long, key long, part int, score_ string, label string")


def odd_texts() -> list:
    """Texts with every oddity that an operator must bear."""
    r = random.Random(5)
    words = "the of and alpha beta gamma delta épsilon straße 漢字 😀 ¿qué? don't can't <|endoftext|> [INST] ▁ \\".split()
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = "\n".join(some(40) for _ in range(60))
    return [None, "", " ", "\n", "\t \n\n  x", "one", "two words", some(12), some(12).upper(), long, long,
            long + "\n" + some(30), "a" * 3000, "= " * 500, "line one is here\n" * 30, "\r\n".join([some(8)] * 3),
            "tab\tand\x0bothers\x0cand \x1c\x1d\x85  spaces  " + some(9), "'re 've 'll 'r 'x don're", "\0nul\0 " + some(5)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return WORD.findall((text or "").translate(LOWER))
