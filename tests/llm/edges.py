"""Awkward documents: NULLs in every column, empty and long texts, ties, repeated rows, clashing names."""

import random

CLASHES = ("row", "key", "found", "host", "chunk", "spans", "fp", "size", "draw", "words", "w", "value", "token", "part", "known", "name", "copies")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)


def rows(seed: int = 3):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(60)] + ["Über", "straße", "ñandú", "naïve", "TOKEN", "don't"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(30)
    texts = [None, "", " \t\n\x0b", "one", "a b c", prose(40), passage, passage, passage.upper(), passage + " end", prose(19), prose(20),
             "\n".join([prose(5)] * 6), prose(12) + " " + prose(8) * 3, "x\u0085y\u00a0z \x1c w", "\U0001f600 " + prose(30),
             prose(6000), "0" * 5000, "a" * 5000 + "@", "1-" * 3000, "a@b." * 800, "### %%% " * 40, "|".join(prose(30).split()),
             f"{passage}\r\n{prose(3)}\r\nmail kim@mail.example.org or +49 (30) 1234-5678", f"mail kim@mail.example.org {prose(30)}",
             "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111 ip 10.1.2.255 10.1.2.256 1.2.3.4.5.6.7.8",
             "x@y..z a@b.c_d@e.f g@h- .i@j.k- +1 +12 +1234567890123456 +1 (743) 555-3824- ..@--.--",
             'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" PASSWORD:hunter22 api-key: x Api_Key="abc/def+12==" AKIA' + "Z" * 20,
             "bearer x9Qv7#kLp2!w pwd: password1 pwd= 2024-01-31 passphrase is Tr7!vQ9zLm##4 deadbeef" * 2]
    out = []
    for i, text in enumerate(texts):
        out.append((i if i != 7 else 6, text, "en" if i % 5 else None, [None, "a", "b", "ü", ""][i % 5], i if i % 3 else None, *[str(i)] * len(CLASHES)))
    out.append((None, passage, None, None, None, *[None] * len(CLASHES)))
    out.append((None, None, None, "a", None, *[None] * len(CLASHES)))
    return out + out[5:9]                                            # repeated rows


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
