"""A small table with everything that is awkward: nulls, repeats, ties, empty and long texts, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, at long, digest string, n long, key string, rank long, group string, copies long, b long, d long, word string, size long, fp long"


def rows(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9)))
    words = [word() for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    texts = [None, "", " ", "\n\n", "a", "a b c", "A\tB\u00a0c", "<|endoftext|>", f"x <|endoftext|> {text(5)}", text(9000), "ab " * 700, "日本語 " * 90, "x" * 3000, "a  b   c \n \n d"]
    for _ in range(40):
        texts.append(text(r.randint(1, 300)))
    for t in texts[14:24]:
        texts += [t, t.replace(" ", "  ", 1), t + " " + word(), f"{text(20)} {passage} {text(30)}"]
    texts += [f"{passage}\n{passage}", "# * $ % & | < >" * 30, "line one here\n" * 40, "SHOUT LOUD " * 50]
    sources = [None, "", "s1", "s2", "hot", "hot", "hot", "é"]
    found = [(i, t, r.choice(["en", "de", None]), r.choice(sources), None, "row", 1, "d", 2, "k", 3, "g", 4, 5, 6, "w", 7, 8) for i, t in enumerate(texts)]
    return found + [found[20], found[20], (None, *found[21][1:]), (None, *found[22][1:]), (None, None, *found[2][2:])]
