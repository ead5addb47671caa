"""Known licence notices and entire licence texts, public ones, as the scan looks them up."""

from itertools import product
from pathlib import Path

# Licence name, text. Statements of copyright holders are left out; the scan removes them from both sides.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GPL3_HEADER),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-public-domain", "This work is in the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Who disclaims and who is not liable, in the usual wordings.
_BSD_PARTIES = [
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS"), ("AUTHOR", "AUTHOR"),
]
_BSD_THIRD = [
    *(f"Neither the name of {who} may be used to endorse or promote products derived from this software without specific prior written permission." for who in (
        "the copyright holder nor the names of its contributors", "the University nor the names of its contributors", "the copyright holders nor the names of its contributors",
        "the author nor the names of its contributors", "the <organization> nor the names of its contributors",
    )),
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
]


def _short() -> list[tuple[str, str]]:
    """Short licences in their usual wordings, below their usual titles, and with the line that often follows the holder."""
    mit = [_MIT, _MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")]
    isc = [_ISC, _ISC.replace("and/or distribute", "and distribute")]
    bsd = {3: [], 2: []}
    for (who, liable), mark in product(_BSD_PARTIES, (True, False)):
        one, two, three = ("1. ", "2. ", "3. ") if mark else ("", "", "")
        bsd[2].append(_BSD.format(one, two, "", who, liable))
        bsd[3] += [_BSD.format(one, two, three + third + "\n", who, liable) for third in _BSD_THIRD]
    titles = [
        ("MIT", ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], mit),
        ("ISC", ["", "ISC License", "The ISC License", "ISC License (ISC)"], isc),
        ("BSD-3-Clause", ["", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"], bsd[3]),
        ("BSD-2-Clause", ["", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"], bsd[2]),
    ]
    return [(name, f"{title}\n{rights}\n{body}") for name, heads, bodies in titles for title, rights, body in product(heads, ("", "All rights reserved."), bodies)]


#: The address of the Free Software Foundation in the texts on file, and the other ones in use.
_FSF = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_FSF_OTHERS = [
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA.", "675 Mass Ave, Cambridge, MA 02139, USA",
]


def _variants(name: str, text: str) -> set[str]:
    """A long licence as it is on file, without what follows its terms, and with other addresses."""
    flat = " ".join(text.replace("\n", " \n ").split(" "))
    out = {flat}
    for end in ("END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice"):
        if end in flat:
            terms = flat[: flat.index(end)]
            out |= {terms, terms + end} if end.startswith("END") else {terms}
    if name in ("GPL-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1"):
        for old in list(out):
            words = " ".join(x for x in old.replace("Boston MA", "Boston, MA").replace("Franklin St,", "Franklin Street,").replace("\n", " \n ").split(" ") if x)
            out |= {words, *(words.replace(_FSF, a) for a in _FSF_OTHERS)}
            out.add(words.replace(f"write to the Free Software Foundation, Inc., \n {_FSF}", "see <https://www.gnu.org/licenses/>").replace(f"write to the Free Software \n Foundation, Inc., {_FSF}", "see <https://www.gnu.org/licenses/>").replace(_FSF, "<https://fsf.org/>"))
            out.add(words.replace(f"write to the Free Software Foundation, Inc., \n {_FSF}", "write to the Free Software Foundation, Inc., " + _FSF).replace(f"\n {_FSF}", "\n"))
    if name == "GPL-2.0":
        out |= {t.replace("GNU Lesser General", "GNU Library General").replace("GNU Lesser \n General", "GNU Library \n General") for t in out}
    if name == "Unlicense":
        out |= {t.replace("http://unlicense.org/", "https://unlicense.org") for t in out} | {t.replace("<http://unlicense.org/>", "") for t in out}
    return out


def _long() -> list[tuple[str, str]]:
    """Entire licences from the files beside this module; Debian's copies of the public texts, and the Unlicense."""
    files = sorted((Path(__file__).parent / "texts").glob("*.txt"))
    return [(f.stem, text) for f in files for text in sorted(_variants(f.stem, f.read_text(encoding="utf-8")))]


KNOWN = NOTICES + _short() + _long()
