"""Licence texts, notices and short references by SPDX identifier; the wording of each is its public one.

The long licences stand in ``license_files``, as their authors publish them; the short ones are here in full.
"""

from __future__ import annotations

from pathlib import Path

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software"""
_UNLICENSE_REST = """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law."""
_ZLIB_REST = """subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and
must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
#: Files of long licences and their identifiers.
_FILES = (
    ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("Artistic", "Artistic-1.0"), ("GFDL-1.3", "GFDL-1.3"),
)
_CC = (("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY", "Attribution"))
_FAMILIES = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))

#: (identifier, text); of equal spans, the first listed wins.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", f"{_MIT} {_MIT_AS_IS}"), ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_AS_IS}"), ("BSD-2-Clause", f"{_BSD_2} {_BSD_AS_IS}"), ("ISC", f"{_ISC} {_ISC_AS_IS}"), ("Zlib", f"{_ZLIB} {_ZLIB_REST}"), ("Unlicense", f"{_UNLICENSE} {_UNLICENSE_REST}"),
    ("MIT", _MIT), ("MIT", _MIT_AS_IS), ("MIT", "under the MIT License"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"), ("BSD-2-Clause", "under the BSD 2-Clause License"), ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("ISC", _ISC), ("ISC", "under the ISC License"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "under the Apache License, Version 2.0"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MPL-2.0", _MPL), ("MPL-2.0", "under the Mozilla Public License, version 2.0"),
    ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("BSL-1.0", _BSL), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "under CC0 1.0"), ("CC0-1.0", "Creative Commons Zero v1.0 Universal"),
]
TEMPLATES += [(_id, (Path(__file__).parent / "license_files" / f"{_file}.txt").read_text("utf-8")) for _file, _id in _FILES]
for _name, _long, _versions in _FAMILIES:
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES += [(_id, _GPL.format(_long, _v)), (_id, f"under the GNU {_long}, version {_v}"), (_id, f"GNU {_long} v{_v}"), (_id, f"SPDX-License-Identifier: {_id}")]
for _short, _long in _CC:
    for _v in ("3.0", "4.0"):
        TEMPLATES += [(f"CC-{_short}-{_v}", f"under CC {_short} {_v}"), (f"CC-{_short}-{_v}", f"under a Creative Commons {_long} {_v} International License")]
