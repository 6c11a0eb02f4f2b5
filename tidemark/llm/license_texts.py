"""Wording of well-known licences, by which documents are scanned. Fixed values.

File headers, notices and the opening or operative paragraphs of MIT, ISC, BSD (2 and 3 clauses), Apache 2.0, MPL 2.0,
EPL 2.0, BSL 1.0, GPL, LGPL and AGPL, the Unlicense, CC0 and the CC BY family in versions 3.0 and 4.0. Full texts of the
long licences, other licences and other versions are not in the list: they give no row, or a header in them does.
"""

# The licences' own words and common notices that name them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:"
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty. You should "
        "have received a copy of the CC0 Public Domain Dedication along with this software."
    ),
    "cc0-1.0-notice": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0"
    ),
}

_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# The conditions alone are common as well, so both stand with and without the disclaimer.
TEMPLATES |= {
    "bsd-2-clause": _CONDITIONS,
    "bsd-2-clause-full": f"{_CONDITIONS} {_DISCLAIMER}",
    "bsd-3-clause": f"{_CONDITIONS} {_NAMES}",
    "bsd-3-clause-full": f"{_CONDITIONS} {_NAMES} {_DISCLAIMER}",
}

# The family's short names, full names and versions; notices and file headers name them in the same words.
for _short, _name, _versions in (
    ("gpl", "GNU General Public License", ("2.0", "3.0")),
    ("lgpl", "GNU Lesser General Public License", ("2.1", "3.0")),
    ("agpl", "GNU Affero General Public License", ("3.0",)),
):
    for _version in _versions:
        _said = _version.removesuffix(".0")
        TEMPLATES[f"{_short}-{_version}-notice"] = f"This work is licensed under the {_name}, version {_said}."
        TEMPLATES[f"{_short}-{_version}"] = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name} as "
            f"published by the Free Software Foundation, either version {_said} of the License, or (at your option) any "
            "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
            f"{_name} for more details."
        )

# Attribution licences: short and long names of the further terms, by version.
for _version in ("3.0", "4.0"):
    for _short, _long in (
        ("", ""),
        ("-sa", "-ShareAlike"),
        ("-nd", "-NoDerivatives"),
        ("-nc", "-NonCommercial"),
        ("-nc-sa", "-NonCommercial-ShareAlike"),
        ("-nc-nd", "-NonCommercial-NoDerivatives"),
    ):
        _scope = {"3.0": "Unported", "4.0": "International"}[_version]
        TEMPLATES[f"cc-by{_short}-{_version}-notice"] = f"Licensed under CC BY{_short.upper()} {_version}."
        TEMPLATES[f"cc-by{_short}-{_version}"] = (
            f"This work is licensed under a Creative Commons Attribution{_long} {_version} {_scope} License."
        )

#: Words that tell one licence from another, and words that a version's numbers follow.
TELLING = frozenset(
    "mit apache isc bsd gnu gpl lgpl agpl affero lesser library mozilla mpl eclipse epl boost unlicense cc cc0 zero nc nd sa "
    "noncommercial noderivatives noderivs sharealike".split()
)
VERSIONED = TELLING | frozenset("version v license licence attribution by commercial derivatives derivs alike".split())
