"""The commonest licence headers and titles, alone and together, and what only looks like them."""

from tidewater.llm.licenses import scan_licenses

FOUND = {
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;": "GPL-2.0",
    "/* SPDX-License-Identifier: GPL-3.0-only */": "GPL-3.0",
    "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: MIT": "MIT",
    "MIT License": "MIT",
    "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n": "MIT",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "Apache-2.0",
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "LGPL-3.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted": "GPL-2.0",
    "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS": "EPL-2.0",
    "Mozilla Public License Version 2.0\n==================================": "MPL-2.0",
    "BSD 3-Clause License": "BSD-3-Clause",
    "BSD 2-Clause License": "BSD-2-Clause",
}
NONE = ["SPDX-License-Identifier: LicenseRef-Own-1.0", "SPDX-License-Identifier: Foo-2.0", "The licence of this house", "A general public meeting, version 3", "License"]


def scanned(spark, texts):
    files = spark.createDataFrame([(i, f"d{i}/LICENSE", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return {r["doc_id"]: r["license"] for r in scan_licenses(files).collect()}


def test_headers_together(spark):
    texts = [*FOUND, *NONE]
    got = scanned(spark, texts)
    assert {t: got[i] for i, t in enumerate(texts)} == {**FOUND, **dict.fromkeys(NONE)}


def test_headers_among_other_files(spark):
    texts = [*FOUND, *NONE, *(f"some words of file {i}, and more. Nothing here grants anything." for i in range(1000))]
    got = scanned(spark, texts)
    assert {t: got[i] for i, t in enumerate(texts)} == {**FOUND, **dict.fromkeys(texts[len(FOUND) :])}


def test_a_header_alone(spark):
    for text in ("BSD 3-Clause License", "SPDX-License-Identifier: LGPL-2.1-or-later", "MIT License"):
        assert scanned(spark, [text])[0] is not None
