from __future__ import annotations

from conftest_llm import ODD, frame

from tallyspark.llm import licenses


def test_sentences_rules_and_odd_rows(spark, odd, none):
    docs = [(1, "x y.\nReleased under the MIT License.", "a"), (2, "Licensed under CC BY-NC 4.0.\nall rights reserved!", "a"), (3, "no licence here", "a")]
    found = {r.doc_id: (r.ids, r.licence) for r in licenses.licences(frame(spark, docs)).collect()}
    assert found == {1: ("MIT-RELEASE", "MIT"), 2: ("CC-BY-NC4,ARR", "CC-BY-NC-4.0"), 3: ("", None)}
    assert licenses.licences(odd).count() == len(ODD) and licenses.licences(none).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
CLAUSE3 = "3. Neither the name of Acme Ltd. nor the names of its contributors may be used to endorse or promote\nproducts derived from this software without specific prior written permission.\n".replace("Ltd.", "Ltd")
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
LATER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License, or (at your option) any later version."
KNOWN = [
    (MIT, "MIT"), (" ".join(MIT.split()), "MIT"), ("\n".join(f" * {x}" for x in MIT.split("\n")), "MIT"), (BSD2 + BSD_END, "BSD-2-Clause"), (BSD2 + CLAUSE3 + BSD_END, "BSD-3-Clause"), (ISC, "ISC"),
    (LATER.format("General Public License", 2), "GPL-2.0-or-later"), (LATER.format("Lesser General Public License", "2.1"), "LGPL-2.1-or-later"), ("This work is licensed under the GNU General Public License version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License\nversion 3.", "GPL-3.0"), ("Foo is licensed under GPL v3 or later.", "GPL-3.0-or-later"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("This text is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Released under CC0 1.0 Universal.", "CC0-1.0"), ("Licensed under the MIT or Apache-2.0 license.", "MIT,Apache-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"), ("Our parser is released under the MIT License, see LICENSE for details.", "MIT"), ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "Apache-2.0"),
    ("It is not licensed under the MIT License.", ""), ("We ask whether it is released under the MIT License.", ""), ("the permit office", ""), ("Licensed under CC BY-NC 4.0.\nall rights reserved!", "CC-BY-NC-4.0,Proprietary"),
]


def test_texts_of_common_licences_in_any_wrapping(spark):
    found = {r.doc_id: r.licences for r in licenses.licences(frame(spark, [(i, t, "a") for i, (t, _) in enumerate(KNOWN)])).collect()}
    assert [(KNOWN[i][0], found[i]) for i in sorted(found)] == KNOWN
