"""More known licences: usual editions of whole texts, usual titles, and usual one-line notices."""

from __future__ import annotations

import re
from pathlib import Path
from string import ascii_lowercase

#: Whole texts as their authors publish them; what follows the terms (how to apply them) may be left out.
FOLDER = Path(__file__).parent / "licenses"
AFTER_TERMS = r"\n[ \t]*(APPENDIX: How to apply|How to Apply These Terms)"

#: Title lines. They and lines that say whose the copyright is are no part of the terms.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: SPDX name, and the names that notices call a licence by.
NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License", "ISC"), "0BSD": ("0BSD License", "0BSD"), "Zlib": ("zlib License", "zlib"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause License", "BSD-3-Clause"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3.0", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0", "LGPL v3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License version 3.0", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
SUBJECTS = ("", "this work is ", "this project is ", "this software is ")


def notices() -> dict[str, tuple[str, ...]]:
    """Name of the notice to its wordings, each a whole line."""
    out = {}
    for spdx, names in NAMES.items():
        ids = [spdx, *([f"{spdx}-only", f"{spdx}-or-later"] if "GPL" in spdx else [])]
        lines = [f"SPDX-License-Identifier: {x}" for x in ids]
        lines += [f"{s}{verb} under {the}{n}" for n in names for s in SUBJECTS for verb in ("licensed", "released") for the in ("", "the ")]
        out[f"{spdx} notice"] = tuple(lines)
    out["MPL-2.0 notice"] += ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    out["MIT OR Apache-2.0 notice"] = ("SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: Apache-2.0 OR MIT")
    return out


def bsd(two: str) -> dict[str, tuple[str, ...]]:
    """Usual forms of the BSD licences, from the text of the one with two clauses: any marks before clauses, usual holders."""
    head, one, copies, as_is = two.split("\n")
    forms: dict[str, list[str]] = {"BSD-2-Clause": [], "BSD-3-Clause": []}
    for who in ("the copyright holder", "the University", "the author", "copyright holders", "the copyright holders"):
        last = f"3. Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        plural = last.replace("its contributors", "their contributors"), last.replace("its contributors", "contributors")
        for by, liable in (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS")):
            end = as_is.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", by).replace("COPYRIGHT HOLDER OR CONTRIBUTORS", liable)
            for name, more in (("BSD-2-Clause", []), *(("BSD-3-Clause", [x]) for x in (last, *plural))):
                clauses = [one, copies, *more]
                forms[name] += ["\n".join([head, *clauses, end]), "\n".join([head, *(c[3:] for c in clauses), end])]
    return {name: tuple(dict.fromkeys(texts)) for name, texts in forms.items()}


def unnumbered(text: str) -> str:
    """The text without numbers before its clauses."""
    return re.sub(r"(?m)^[0-9]\. ", "", text)


def editions(first: dict[str, str]) -> dict[str, str | tuple[str, ...]]:
    """Of each licence all known texts and of each notice all wordings; the texts of first come first."""
    out: dict[str, tuple[str, ...]] = {name: (text,) for name, text in first.items()}
    for name, more in (bsd(first["BSD-2-Clause"]) | {"Zlib": (unnumbered(first["Zlib"]),)} | notices()).items():
        out[name] = (*out.get(name, ()), *more)
    out["ISC"] += (out["ISC"][0].replace("and/or", "and"),)
    for path in sorted(FOLDER.glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        terms = re.split(AFTER_TERMS, whole)[0]
        out[path.stem] = tuple(dict.fromkeys(x for t in (whole, terms) for x in (t, t.replace("https://", "http://"), re.sub(r"\n[ \t]*END OF TERMS AND CONDITIONS\s*$", "\n", t))))
    for name, titles in TITLES.items():  # a title in the line of the terms' first words
        out[name] += tuple(f"{title} {text}" for title in titles for text in out[name][:2])
    return {name: texts[0] if len(texts) == 1 else texts for name, texts in out.items()}


def title_line() -> str:
    """A regular expression of the titles, each a whole line of lower-cased text."""
    words = {re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() for titles in TITLES.values() for t in titles}
    return "(" + "|".join(w.replace(" ", r"[^a-z0-9\n]+").replace("license", "licen[cs]e") for w in sorted(words)) + r")[^a-z0-9\n]*$"


def other_than(words: set[str]) -> str:
    """A regular expression, without lookahead, of a whole run of letters a to z that is none of words."""
    heads = sorted({w[0] for w in words if w})
    parts = [f"{h}({other_than({w[1:] for w in words if w[:1] == h})})" for h in heads]
    rest = "".join(c for c in ascii_lowercase if c not in heads)
    return "|".join([*parts, f"[{rest}][a-z]*", *([] if "" in words else [""])])


def name_line(texts: list[str]) -> str:
    """A regular expression of "copyright" and a name, in lower-cased text.

    What follows the word within a known text begins no name, as a wrapped line of that text may begin so.
    """
    within = {w for t in texts for w in re.findall(r"\bcopyright\s+([a-z]+)", t.lower())} | {"", "and", "holder", "holders", "owner", "owners", "the"}
    known = rf"({other_than(within)})([^a-z\n][^\n]{{0,80}})?"
    return rf"copyright[ \t]+({known}|[^\x00-\x7f][^\n]{{0,80}}|the[ \t][^\n]{{0,60}}(authors|contributors|developers|foundation|project|team)[^a-z0-9\n]*)$"
