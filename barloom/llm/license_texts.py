"""Wording of licenses as templates: fixed values, public texts with optional and replaceable regions.

``[[ ... ]]`` is a region that may be missing. ``{{name:2-5}}`` stands for two to five words of any kind, ``{{name=a|b}}`` for one of the words
that it lists. All else is mandatory; case, punctuation and layout do not count.
"""

#: Base labels and the phrases that give them.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_NOTICE = "[[This {{thing=work|software|program|project|file|library}} is]] {{verb=licensed|released|distributed|available|published}} under"

NOTICES = [
    ("MIT", f"{_NOTICE} the [[terms of the]] MIT License"),
    ("Apache-2.0", f"{_NOTICE} the [[terms of the]] Apache [[Software]] License [[,]] [[Version]] 2.0"),
    ("BSD", f"{_NOTICE} {{{{article=a|the}}}} [[terms of the]] [[{{{{clauses=2|3|two|three}}}} clause]] BSD License"),
    ("MPL-2.0", f"{_NOTICE} the [[terms of the]] Mozilla Public License [[,]] {{{{v=v|version}}}} 2.0"),
    *((f"GPL-{v}.0", f"{_NOTICE} the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[either]] {{{{v=v|version}}}} {v} [[of the License]]") for v in (2, 3)),
    *(
        (f"CC-{kind}-{v}", f"{_NOTICE} [[{{{{article=a|the}}}}]] [[Creative Commons]] [[license]] CC {kind} {v}")
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
        for v in ("3.0", "4.0")
    ),
    ("SPDX-tag", "SPDX-License-Identifier: {{id=apache|bsd|cc|cc0|gpl|isc|lgpl|mit|mpl|unlicense|zlib}}"),
]

TEXTS = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{holders:1-12}} BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, [[and/or]] [[and]] distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{author:1-8}} DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{author:1-8}} BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE""",
    ),
    *(
        (
            label,
            f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
            met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [[2]]
            Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
            documentation and/or other materials provided with the distribution. {third} THIS SOFTWARE IS PROVIDED BY {{{{holders:1-12}}}} "AS IS" AND ANY
            EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
            ARE DISCLAIMED. IN NO EVENT SHALL {{{{holders:1-12}}}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
            DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
            HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
            ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
        )
        for label, third in (
            ("BSD-2-Clause", ""),
            (
                "BSD-3-Clause",
                """[[3]] Neither the name of {{organization:1-12}} nor the names of its contributors may be used to endorse or promote products derived
                from this software without specific prior written permission.""",
            ),
        )
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at {{address:1-12}} Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License""",
    ),
    *(
        (
            f"GPL-{v}.0-or-later",
            f"""This {{{{thing=program|library|software|file}}}} is free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General
            Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version""",
        )
        for v in (2, 3)
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        [[then]] You can obtain one at""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: [[1]] The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. [[3]] This notice may not be removed or altered from any source distribution""",
    ),
]

TEMPLATES = NOTICES + TEXTS
