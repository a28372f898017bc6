"""Default templates of the licence scan: short notices, file headers and full
texts, with the words that tell one licence from another.

A template's name is its licence, with ``-text``, ``-header``, ``-full``, ``-short``
or ``-long`` where a licence has several forms.
"""

from __future__ import annotations

from importlib import resources

FORMS = ("-text", "-header", "-full", "-short", "-long")

_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:")
_GNU_HEADER = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the {license} as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your option) "
    "any later version.")

# Notices and short texts by licence name, each with the phrases
# that must stand in the matched span word by word.
NOTICES = {
    "MIT": ("Released under the MIT License.", ("MIT",)),
    "MIT-text": (_MIT_GRANT, ()),
    "MIT-full": (
        _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ()),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("Apache License", "2.0")),
    "Apache-2.0-short": ("Licensed under the Apache License, v2.0.", ("Apache License", "v2.0")),
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0", ("Apache License", "2.0")),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.", ("Apache License", "2.0")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                ("GNU General Public License", "version 2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                ("GNU General Public License", "version 3")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 ("GNU Lesser General Public License", "version 2.1")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",
                 ("GNU Lesser General Public License", "version 3")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",
                 ("GNU Affero General Public License", "version 3")),
    "GPL-2.0-text": (_GNU_HEADER.format(what="This program", license="GNU General Public License", version="2"),
                     ("GNU General Public License", "version 2")),
    "GPL-3.0-text": (_GNU_HEADER.format(what="This program", license="GNU General Public License", version="3"),
                     ("GNU General Public License", "version 3")),
    "LGPL-2.1-text": (
        _GNU_HEADER.format(what="This library", license="GNU Lesser General Public License", version="2.1"),
        ("GNU Lesser General Public License", "version 2.1")),
    "LGPL-3.0-text": (
        _GNU_HEADER.format(what="This library", license="GNU Lesser General Public License", version="3"),
        ("GNU Lesser General Public License", "version 3")),
    "AGPL-3.0-text": (
        _GNU_HEADER.format(what="This program", license="GNU Affero General Public License", version="3"),
        ("GNU Affero General Public License", "version 3")),
    "BSD": ("Released under the BSD License.", ("BSD",)),
    "BSD-text": ("Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met:", ()),
    "BSD-2-Clause-full": (_BSD_START + _BSD_END, ()),
    "BSD-3-Clause-full": (_BSD_START + _BSD_NAMES + _BSD_END, ("endorse or promote products",)),
    "ISC": ("Released under the ISC License.", ("ISC",)),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ()),
    "Zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.", ()),
    "Unlicense-full": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.", ()),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                ("Mozilla Public License", "2.0")),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License", "2.0")),
    "CC-BY-4.0-short": ("Licensed under CC BY 4.0.", ("CC BY 4.0",)),
    "CC-BY-SA-4.0-short": ("Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    "CC-BY-ND-4.0-short": ("Licensed under CC BY-ND 4.0.", ("CC BY-ND 4.0",)),
    "CC-BY-NC-SA-4.0-short": ("Licensed under CC BY-NC-SA 4.0.", ("CC BY-NC-SA 4.0",)),
    "CC-BY-NC-ND-4.0-short": ("Licensed under CC BY-NC-ND 4.0.", ("CC BY-NC-ND 4.0",)),
    "CC0-1.0-short": ("Licensed under CC0 1.0 Universal.", ("CC0 1.0",)),
    **{name: (f"This work is licensed under a Creative Commons {title} 4.0 International License.", (f"{title} 4.0",))
       for name, title in (
           ("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"),
           ("CC-BY-NC-4.0-long", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"),
           ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"),
           ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"))},
}

# Licences whose full text lies in ``license_texts``, and the
# version line of those that differ from another by it.
FULL_TEXTS = {
    "Apache-2.0": (), "CC0-1.0": (), "GPL-2.0": ("Version 2, June 1991",), "GPL-3.0": ("Version 3, 29 June 2007",),
    "LGPL-2.1": ("Version 2.1, February 1999",), "LGPL-3.0": ("Version 3, 29 June 2007",), "MPL-2.0": (),
}


def licence_of(name: str) -> str:
    """The licence that a template's name stands for."""
    for form in FORMS:
        name = name.removesuffix(form)
    return name


def full_texts() -> dict[str, str]:
    folder = resources.files(__package__) / "license_texts"
    return {f"{name}-full": (folder / f"{name}.txt").read_text() for name in FULL_TEXTS}


TEMPLATES = {name: text for name, (text, _) in NOTICES.items()} | full_texts()
TELLING = {name: phrases for name, (_, phrases) in NOTICES.items()} | {
    f"{name}-full": phrases for name, phrases in FULL_TEXTS.items()}
