import pytest

from vacantia.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "MIT"),
    ],
)
def test_notices(scanner, text, name):
    got = scanner.scan(f"Some words before.\n{text}\nSome words after.")
    assert [g[2] for g in got] == [name] and got[0][1].startswith(text[:20])


@pytest.mark.parametrize("text", ["", "A driving licence is needed.", "The license fee went up by ten per cent this year, they said.", "We offer warranties on all fridges sold in the shop.", "License license license"])
def test_clean(scanner, text):
    assert scanner.scan(text) == []


def test_ranking_and_differences(scanner):
    reduction, best = scanner.rank("Licensed under the Apache License, Version 2.0.")[0]
    assert best == "Apache-2.0" and reduction > 0.4
    own = licenses._words(licenses.LICENSES["ISC"].text.replace("hereby granted", "hereby most kindly granted"))
    _, extra, gaps, common, skipped, span, ends = scanner.stretch(own, "ISC")
    assert extra == ["most", "kindly"] and gaps == [] and common == len(own) - 2 and skipped == 0 and span == (0, len(own)) and ends == 0


def test_scanned(docs, empty, spark):
    more = spark.createDataFrame([(100, ("x\nReleased under the MIT License.\n" + "y " * 60 + "\n") * 3), (101, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scanned(more).collect()}
    assert rows[100]["licenses"] == "MIT" and rows[100]["n_blocks"] == 3 and rows[101]["licenses"] == ""
    assert licenses.scanned(docs).filter("n_blocks > 0").count() == 0 and licenses.scanned(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scanned(docs.withColumnRenamed("feature", "licenses"))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        *((f"This article is available under the terms of CC {k} 4.0 license.", f"CC-{k}-4.0") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA")),
        ("All text is published under CC BY 4.0, a free license.", "CC-BY-4.0"),
        ("Copyright (c) 2024 Jane Doe, released under the MIT License.", "MIT"),
        ("Copyright 2019 Jane Doe and 12 others, licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ],
)
def test_notices_within_other_words(scanner, text, name):
    assert [g[2] for g in scanner.scan(text)] == [name]


@pytest.mark.parametrize("text", ["He is licensed under the act of 1998 to sell fish.", "I read the MIT License yesterday.", "Licensed under CC BY 3.0."])
def test_other_versions_and_mentions(scanner, text):
    assert scanner.scan(text) == []


@pytest.mark.parametrize("name", list(licenses.LICENSES))
def test_every_template_is_itself(scanner, name):
    assert {g[2] for g in scanner.scan(licenses.TEMPLATES[name])} == {name}
    text = licenses.LICENSES[name].text
    if text:
        assert {g[2] for g in scanner.scan(text)} == {name}
        assert {g[2] for g in scanner.scan(f"Some prose before it.\n\n{text.replace('. ', '.' + chr(10))}\n\nSome prose behind it.")} == {name}


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the zlib License.", "Zlib"),
        ("Released under the Eclipse Public License.", "EPL-1.0 OR EPL-2.0"),
        ("Released under the Zope Public License.", "ZPL-2.1"),
        ("Released under the Boost License.", "BSL-1.0"),
        ("Licensed under GPLv3.", "GPL-3.0"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("Licensed under the MIT License. Parts are released under the GNU General Public License, version 3.", "GPL-3.0,MIT"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later\nversion. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", "LGPL-2.1"),
        ("You may use it under the terms of the Frobnitz License, version 2.", ""),
    ],
)
def test_names_versions_and_blocks(scanner, text, name):
    assert ",".join(sorted({g[2] for g in scanner.scan(text)})) == name


def test_clauses_of_a_wrapped_notice(scanner):
    import textwrap

    for name in ("BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MIT", "X11", "Zlib", "ISC", "0BSD"):
        wrapped = "\n".join(textwrap.wrap(licenses.LICENSES[name].text.replace("copyright holder", "Example Company"), 72))
        assert {g[2] for g in scanner.scan(f"Copyright (c) 2014 Example Company\n\n{wrapped}\n")} == {name}
        bullets = wrapped.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
        assert {g[2] for g in scanner.scan(bullets)} == {name}


def test_ranking_against_brute_force(scanner):
    import zstandard

    block = "Permission is granted to anyone to use this software for any purpose, including commercial applications."
    size = lambda t: len(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if t else None).compress(block.lower().encode()))
    lowered = lambda k: " ".join(f"{licenses._statement(k, v)} {v.text}".lower().split()) if (v := licenses.LICENSES[k]) else ""
    want = {k: size(lowered(k)) for k in licenses.LICENSES}
    assert scanner.rank(block)[0][1] == min(want, key=want.get) == "Zlib"


def test_long_pieces_are_looked_at_in_parts(scanner):
    text = "word " * 3000 + "and it is licensed under the Apache License, Version 2.0 " + "word " * 3000
    assert [g[2] for g in scanner.scan(text)] == ["Apache-2.0"]


WORDED = [k for k, v in licenses.LICENSES.items() if v.text]


@pytest.mark.parametrize("step", [1, 2, 7, 18])
def test_two_notices_in_one_block(scanner, step):
    """Ordered pairs of templates with a blank line between: both are found, nothing else."""
    for k, a in enumerate(WORDED):
        b = WORDED[(k + step) % len(WORDED)]
        assert {g[2] for g in scanner.scan(f"{licenses.LICENSES[a].text}\n\n{licenses.LICENSES[b].text}")} == {a, b}


@pytest.mark.parametrize("times", [2, 5, 20])
def test_repeated_notices(scanner, times):
    for k in WORDED:
        assert {g[2] for g in scanner.scan("\n\n".join([licenses.LICENSES[k].text] * times))} == {k}


def test_three_notices_among_prose(scanner):
    own = [licenses.LICENSES[k].text for k in ("MIT", "BSD-3-Clause", "Zlib")]
    got = scanner.scan("Some prose.\n" + "\nCopyright (c) 2001 A. Body\n".join(own) + "\nMore prose stands here.")
    assert {g[2] for g in got} == {"MIT", "BSD-3-Clause", "Zlib"}


@pytest.mark.parametrize(
    "text",
    [
        "This is not licensed under the MIT License.",
        "It was never released under the GPL.",
        "The files are not available under the terms of the Apache License, Version 2.0.",
        "Er fuhr mit unter der Bank, mit dem Hund.",
        "A fee is licensed under law.",
        "This code isn't licensed under MIT.",
    ],
)
def test_negations_and_chance_words(scanner, text):
    assert scanner.scan(text) == []


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under MIT.", "MIT"),
        ("MIT Licensed", "MIT"),
        ("License: MIT", "MIT"),
        ("License: GPL-3.0-or-later", "GPL-3.0"),
        ("Licensed under the GPL.", "GPL-2.0 OR GPL-3.0 OR GPL-1.0"),
        ("Licensed under the GPL, version 2 or later.", "GPL-2.0"),
        ("The code is BSD licensed.", "BSD-3-Clause OR BSD-2-Clause OR BSD-1-Clause OR BSD-4-Clause"),
        ("Dieser Text steht unter der MIT-Lizenz.", "MIT"),
        ("Ce texte est sous licence MIT.", "MIT"),
        ("Este texto se publica bajo la licencia Apache 2.0.", "Apache-2.0"),
        ("It is not only licensed under the MIT License but also free of charge.", "MIT"),
        ("Licensed under MIT No Attribution.", "MIT-0"),
    ],
)
def test_short_names_after_a_cue(scanner, text, name):
    assert [g[2] for g in scanner.scan(text)] == [name]


def cover(scanner, words):
    """Brute force: of every template, as often as it stands word for word in what is left, longest first."""
    found, rest = set(), words
    for k in sorted(WORDED, key=lambda k: -len(scanner.words[k])):
        own = scanner.words[k]
        while (at := next((i for i in range(len(rest) - len(own) + 1) if rest[i : i + len(own)] == own), None)) is not None:
            found.add(k)
            rest = rest[:at] + ["|"] * 3 + rest[at + len(own) :]
    return found


def test_blocks_against_exact_cover(scanner):
    import random

    r = random.Random(3)
    for _ in range(25):
        picks = [r.choice(WORDED) for _ in range(r.randint(1, 4))]
        text = "\n\n".join(licenses.LICENSES[k].text for k in picks)
        assert {g[2] for g in scanner.scan(text)} == cover(scanner, licenses._words(text)) == set(picks)
