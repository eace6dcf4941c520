"""Canonical licence texts and notices, as published. Fixed values.

TEXTS: id -> whole texts, the long ones from files in ``licenses``, and standard
header notices. NAMES and FORMS make the one-line notices by which works usually
state a licence.
"""

from importlib.resources import files

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

TEXTS = {
    "MIT": [_MIT_BODY, "MIT License\n\n" + _MIT_BODY, "The MIT License (MIT)\n\n" + _MIT_BODY],
    "ISC": [f"{x}{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}" for x in ("", "ISC License\n\n")],
    "0BSD": [f"{x}{_ISC_GRANT}.\n\n{_ISC_WARRANTY}" for x in ("", "Zero-Clause BSD License\n\n", "BSD Zero Clause License\n\n")],
    "BSD-2-Clause": [f"{x}{_BSD_HEAD}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_WARRANTY}" for x in ("", "BSD 2-Clause License\n\n", "The 2-Clause BSD License\n\n")],
    "BSD-3-Clause": [f"{x}{_BSD_HEAD}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_THREE}\n\n{_BSD_WARRANTY}" for x in ("", "BSD 3-Clause License\n\n", "The 3-Clause BSD License\n\n")],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
}

#: Ids whose published text is a file.
PUBLISHED = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
_END = "END OF TERMS AND CONDITIONS"


def _published(name: str) -> list[str]:
    """The text of a file, and without the appendix that follows its terms."""
    text = files(__package__).joinpath("licenses", f"{name}.txt").read_text("utf-8")
    terms = text.partition(_END)[0]
    return [text, terms, terms + _END] if _END in text else [text]


TEXTS |= {name: _published(name) for name in PUBLISHED}

_APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
_GNU = {"GPL-2.0": ("General", 2), "GPL-3.0": ("General", 3), "LGPL-3.0": ("Lesser General", 3), "AGPL-3.0": ("Affero General", 3)}


def _gnu_headers(kind: str, version: int) -> list[str]:
    """The header, and its first paragraph alone, which names the licence."""
    out = []
    for work in ("program", "library", "software"):
        first = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, "
        warranty = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
        copy = f"You should have received a copy of the GNU {kind} Public License along with this {work}"
        tails = [f"{copy}. If not, see <https://www.gnu.org/licenses/>.", f"{copy}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
        for which in (f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License.", f"version {version}."):
            out += [first + which, *[f"{first}{which}\n\n{warranty}\n\n{tail}" for tail in tails]]
    return out


#: id -> standard header notices of several sentences, and the paragraph of each that names the licence.
HEADERS = {
    "Apache-2.0": ["\n\n".join(_APACHE), " ".join(_APACHE[:2]), _APACHE[0]],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    **{name: _gnu_headers(*of) for name, of in _GNU.items()},
}

#: id -> the names by which notices call the licence.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
FORMS = [
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}",
    "This work is licensed under a {}", "This software is licensed under the {}", "Distributed under the {}", "This project is licensed under the {}",
]
SPDX = "SPDX-License-Identifier: {}"

FAMILIES = {
    "permissive": ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "CC0-1.0", "CC-BY-4.0"],
    "copyleft": ["GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0"],
    "restricted": ["CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0"],
}

#: Spellings taken as equal, as the common matching guidelines list them: pattern -> form.
EQUIVALENT = [
    ("licenc", "licens"), ("sub license", "sublicense"), ("analogue", "analog"), ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("cancelled", "canceled"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("programme", "program"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("while redistributing", "redistributing"), ("copyright owner", "copyright holder"), ("https ", "http "), ("version ([0-9])", "v $1"), (r"\bv([0-9])", "v $1"),
]
