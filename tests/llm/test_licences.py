"""Published licence notices, plain and as comments."""

import pytest
from pyspark.sql import functions as F

from episodica.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {0} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
NOTICES = [(GPL.format(3), "GPL-3.0-or-later"), (GPL.format(2), "GPL-2.0-or-later"), (GPL.format(2).replace("software:", "software;"), "GPL-2.0-or-later"), (MIT, "MIT"), (BSD, "BSD")]
MARKS = [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("", "-- ", ""), ("/*\r\n", " * ", "\r\n */")]


@pytest.mark.parametrize("head, mark, tail", MARKS)
def test_published_notices(spark, head, mark, tail):
    end = "\r\n" if "\r" in head else "\n"
    rows = [(head + end.join((mark + line).rstrip() for line in text.splitlines()) + tail + end + end + "int main();", want) for text, want in NOTICES]
    docs = spark.createDataFrame(rows, "text string, want string")
    for want, found in licenses.scan(docs).select("want", F.array_join("licences", ",")).collect():
        assert found == want


def test_notices_of_other_licences(spark):
    """Every phrase goes with every name, and bodies count in part."""
    rows = [
        ("This work is licensed under the MIT License.", "MIT"),
        ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
        ("This work is licensed under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later"),
        ("Distributed under the GNU Lesser General Public License v2.1.", "LGPL-2.1-only"),
        ("Released under the GNU AGPL version 3.", "AGPL-3.0-only"),
        ("This project is released under the terms of the Mozilla Public License 2.0.", "MPL-2.0"),
        ("Licensed under the ISC license.", "ISC"),
        ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        *((f"// SPDX-License-Identifier: {tag}\n", want) for tag, want in (("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0+", "GPL-2.0-or-later"), ("LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("MPL-2.0", "MPL-2.0"), ("BSD-2-Clause", "BSD-2-Clause"))),
        ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */\nint x;", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) AND (MIT OR ISC)\n", "GPL-2.0-or-later,ISC,MIT"),
        ("SPDX-License-Identifier: MIT\nOne WITH two OR Apache-2.0 AND ISC", "MIT"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        (MIT.split("\n\n")[2], "MIT"),
        (BSD.split("\n\n")[2], "BSD"),
        ("We released this under the sun. MIT License. > mit license. notice mit", ""),
    ]
    docs = spark.createDataFrame(rows, "text string, want string")
    for want, found in licenses.scan(docs).select("want", F.array_join("licences", ",")).collect():
        assert found == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Dual licensed under MIT and GPL v2.", ["GPL-2.0-only", "MIT"]),
        ("Licensed under the MIT License and the Apache License 2.0.", ["Apache-2.0", "MIT"]),
        ("License: MIT", ["MIT"]),
        ("# License: Apache-2.0\nimport x", ["Apache-2.0"]),
        (" * Licence: GPL-3.0-or-later\n */", ["GPL-3.0-or-later"]),
        ("Licensed under the Artistic License 2.0.", ["Artistic-2.0"]),
        ("Released under the WTFPL", ["WTFPL"]),
        ("This software is released under the PostgreSQL License.", ["PostgreSQL"]),
        ("Licensed under GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later"]),
        ("Licensed under the GNU General Public License, version 2 or any later version.", ["GPL-2.0-or-later"]),
        ("Licensed under the MIT License and a house rule.", []),
        ("Driving license: valid", []),
        ("He has a license: MIT students need none.", []),
        ("License: none", []),
    ],
)
def test_notices_of_several_licences_and_fields(spark, text, want):
    found = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert found.licences == want
