"""Known licence texts and notices.

Full texts are fixed values, the long ones files of the folder ``licences``;
notices are made by a rule from names, addresses and phrases.
"""

from __future__ import annotations

import re
from importlib.resources import files

#: Identifiers and the names that notices use for them (fixed values).
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL 3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL 3", "LGPLv3"],
    "MIT": ["MIT License", "Expat License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}

#: SPDX identifiers that say whether later versions are meant too (rule).
NAMES |= {k: [*v, f"{k}-only", f"{k}-or-later"] for k, v in NAMES.items() if "GPL-" in k}

#: Addresses of licences (fixed values).
URLS = {
    "AGPL-3.0": ["https://www.gnu.org/licenses/agpl-3.0.html", "https://www.gnu.org/licenses/agpl-3.0.en.html", "https://www.gnu.org/licenses/agpl-3.0.txt"],
    "Apache-2.0": ["https://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0.html", "https://www.apache.org/licenses/LICENSE-2.0.txt"],
    "BSL-1.0": ["https://www.boost.org/LICENSE_1_0.txt"],
    "CC-BY-4.0": ["https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by/4.0/legalcode"],
    "CC-BY-NC-4.0": ["https://creativecommons.org/licenses/by-nc/4.0/", "https://creativecommons.org/licenses/by-nc/4.0/legalcode"],
    "CC-BY-ND-4.0": ["https://creativecommons.org/licenses/by-nd/4.0/", "https://creativecommons.org/licenses/by-nd/4.0/legalcode"],
    "CC-BY-SA-4.0": ["https://creativecommons.org/licenses/by-sa/4.0/", "https://creativecommons.org/licenses/by-sa/4.0/legalcode"],
    "CC0-1.0": ["https://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/publicdomain/zero/1.0/legalcode"],
    "EPL-2.0": ["https://www.eclipse.org/legal/epl-2.0/", "https://www.eclipse.org/legal/epl-v20.html"],
    "GPL-2.0": ["https://www.gnu.org/licenses/old-licenses/gpl-2.0.html", "https://www.gnu.org/licenses/old-licenses/gpl-2.0.txt"],
    "GPL-3.0": ["https://www.gnu.org/licenses/gpl-3.0.html", "https://www.gnu.org/licenses/gpl-3.0.en.html", "https://www.gnu.org/licenses/gpl-3.0.txt"],
    "LGPL-2.1": ["https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html", "https://www.gnu.org/licenses/old-licenses/lgpl-2.1.txt"],
    "LGPL-3.0": ["https://www.gnu.org/licenses/lgpl-3.0.html", "https://www.gnu.org/licenses/lgpl-3.0.txt"],
    "MIT": ["https://opensource.org/licenses/MIT", "https://opensource.org/license/mit"],
    "MPL-2.0": ["https://mozilla.org/MPL/2.0/", "https://www.mozilla.org/MPL/2.0/"],
    "Unlicense": ["https://unlicense.org/"],
}

#: Sentences that name a licence (fixed values).
PHRASES = [
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "Distributed under the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This software is licensed under the {}",
    "This software is released under the {}",
    "This project is licensed under the {}",
    "This program is licensed under the {}",
    "This file is licensed under the {}",
    "SPDX-License-Identifier: {}",
]

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Full texts and file headers (fixed values), without copyright lines.
TEXTS = [
    ("MIT", "MIT License\n" + _MIT_GRANT + _AS_IS),
    ("MIT", _MIT_GRANT + _AS_IS),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_CONDITIONS + _BSD_AS_IS),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_CONDITIONS + _BSD_NAME + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAME + _BSD_AS_IS),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
]


#: Where the advice behind the terms begins, which many copies leave out.
_ENDS = re.compile(r"\n[ \t]*(APPENDIX: How to apply|How to Apply These Terms)")
#: Lines that stay lines where a paragraph is written as one line.
_OWN_LINE = re.compile(r"(?i)[ \t]*copyright (\(c\)|\[)")


def _one_line_paragraphs(text: str) -> str:
    out = []
    for line in text.split("\n"):
        if out and out[-1].strip() and line.strip() and not (_OWN_LINE.match(line) or _OWN_LINE.match(out[-1])):
            out[-1] += " " + line.strip()
        else:
            out.append(line)
    return "\n".join(out)


def long_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files, whole and without the advice at the end, wrapped and not."""
    out = []
    for file in sorted(files("waveline.llm").joinpath("licences").iterdir(), key=lambda f: f.name):
        whole = file.read_text(encoding="utf-8")
        for text in dict.fromkeys([whole, _ENDS.split(whole)[0]]):
            out += [(file.name.removesuffix(".txt"), form) for form in (text, _one_line_paragraphs(text))]
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of full texts, and of a notice for each phrase and name; an address alone is a notice too."""
    notices = [(licence, phrase.format(name)) for licence, names in NAMES.items() for phrase in PHRASES for name in [licence, *names]]
    addresses = [(licence, phrase.format(url)) for licence, urls in URLS.items() for phrase in ["{}", *PHRASES] for url in urls]
    return TEXTS + long_texts() + notices + addresses
