"""Full texts of common licences with their usual variants, for the digest table.

Long texts are the files beside this module, as their publishers give them; short ones are put
together below.  Holders, years and punctuation are no part of the canonical form.  Texts with a
name filled into their body (other than those below) have no fixed digest and are not known.
"""

from __future__ import annotations

from importlib.resources import files
from itertools import product

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_NOTICE = ", subject to the following conditions:\n\nThe above copyright notice and this permission notice{next} shall be included in all copies or substantial portions of the Software."
ISC_GRANT = "Permission to use, copy, modify, {and_or} distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission.",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_WHO = (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
           ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHOR", "AUTHOR"))
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    + WARRANTY.format(who="AUTHORS")
)
# Where the application guide of a long text begins; the last line of the terms stands before it or is left out with it.
GUIDES = ("How to Apply These Terms", "Appendix: How to Apply", "APPENDIX: How to apply", "Exhibit A - Source", "EXHIBIT A -Mozilla")
END = "END OF TERMS AND CONDITIONS"
LONG = ("Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
STREETS = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def _titled(titles: tuple[str, ...], body: str, reserved: bool = False) -> list[str]:
    heads = product(titles, ("", "All rights reserved.\n\n") if reserved else ("",))
    return [(t + "\n\n" if t else "") + r + body for t, r in heads]


def _short() -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []

    def add(license_id: str, titles: tuple[str, ...], body: str, reserved: bool = False) -> None:
        found.extend((license_id, t) for t in _titled(("", *titles), body, reserved))

    for after, who in product(("", " (including the next paragraph)"), ("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")):
        body = f"{MIT_GRANT}{MIT_NOTICE.format(next=after)}\n\n{WARRANTY.format(who=who)}"
        add("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), body, reserved=True)
    add("MIT-0", ("MIT No Attribution", "MIT No Attribution License"), f"{MIT_GRANT}.\n\n{WARRANTY.format(who='AUTHORS OR COPYRIGHT HOLDERS')}")
    for and_or, who in product(("and/or", "and"), ("THE AUTHOR", "ISC")):
        warranty = ISC_WARRANTY.format(who=who)
        add("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), f"{ISC_GRANT.format(and_or=and_or)}{ISC_NOTICE}.\n\n{warranty}")
        add("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), f"{ISC_GRANT.format(and_or=and_or)}.\n\n{warranty}")
    for numbers, (by, who) in product((("1. ", "2. ", "3. "), ("* ", "* ", "* ")), BSD_WHO):
        warranty = BSD_WARRANTY.format(by=by, who=who)
        two = "\n\n".join([BSD_GRANT, *[n + c for n, c in zip(numbers, BSD_CONDITIONS)]])
        add("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), f"{two}\n\n{warranty}", reserved=True)
        for names in BSD_NAMES:
            add("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), f"{two}\n\n{numbers[2]}{names}\n\n{warranty}", reserved=True)
    for link in ("", "https://unlicense.org", "http://unlicense.org/"):
        add("Unlicense", ("The Unlicense", "Unlicense"), UNLICENSE + (f"\n\nFor more information, please refer to <{link}>" if link else ""))
    return found


def _long(license_id: str) -> list[tuple[str, str]]:
    whole = files(__package__).joinpath(f"{license_id}.txt").read_text(encoding="utf-8")
    forms = [whole]
    guide = min((whole.find(g) for g in GUIDES if g in whole), default=-1)
    if guide > 0:
        terms = whole[:guide]
        forms += [terms, terms.replace(END, "")]
    elif END in whole:
        forms.append(whole.replace(END, ""))
    for street in STREETS[1:]:
        forms += [f.replace(old, street) for f in list(forms) for old in {STREETS[0], STREETS[0].replace("MA 02110", "MA  02110").replace("1301 USA", "1301  USA")} if old in f]
    forms += [f.replace("https://", "http://") for f in list(forms)] + [f.replace("http://", "https://") for f in list(forms)]
    return [(license_id, f) for f in dict.fromkeys(forms)]


def full_texts() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of every known wording."""
    return (*_short(), *(row for license_id in LONG for row in _long(license_id)))
