"""Public wording of common licenses: notices, short texts, and the folder of long ones (``licenses``)."""

from __future__ import annotations

from pathlib import Path

_GNU = {
    "GPL-1.0": ("GNU General Public License", "1"), "GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.0": ("GNU Library General Public License", "2"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the"
_BY = "as published by the Free Software Foundation"
#: Names that a one-line notice gives a license.
_NAMES = {
    "MIT": ("MIT License", "MIT/X11 License", "MIT (Expat) License", "Expat License"),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache License v2", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0 License"),
    "BSL-1.0": ("Boost Software License", "Boost Software License, Version 1.0"),
    "Unlicense": ("Unlicense license", "terms of the Unlicense"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero license", "Creative Commons CC0 license"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    **{i: tuple(x for n in (f"{v}", f"{v}.0") if "." not in v or n == v for x in (
        f"{name} version {n}", f"{name}, version {n}", f"{name} v{n}", f"{i.split('-')[0]} version {n}", f"{i.split('-')[0]} v{n}",
        f"{i.split('-')[0]}v{n} license", f"GNU {i.split('-')[0]} v{n}", f"GNU {i.split('-')[0]} version {n}", f"{i.split('-')[0]}-{n} license",
    )) for i, (name, v) in _GNU.items()},
    **{f"CC-{k}-{v}": tuple(f"{x} {v}{end}" for x in (f"CC {k}", f"CC-{k}", f"Creative Commons {long}") for end in ("", " License", " International License"))
       for v in ("3.0", "4.0") for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                                               ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
_VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "shared", "terms of", "covered by", "subject to")


def _lines(name: str) -> list[str]:
    article = "" if name.startswith(("CC", "terms")) else "the "
    starts = [f"{v} under" if v in _VERBS[:7] else v for v in _VERBS]
    return [f"{s} {a}{name}" for s in starts for a in {article, "a " if name.startswith("Creative") else article}]


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " \
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. " \
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation " \
    "and/or other materials provided with the distribution."  # fmt: skip
#: License id: notices and short texts. Words that a project fills in (its name, its holder) are left out.
NOTICES: dict[str, list[str]] = {i: [line for n in names for line in _lines(n)] for i, names in _NAMES.items()}
for _i, (_name, _v) in _GNU.items():
    NOTICES[_i] += [
        f"{_FREE} {_name} {_BY}, either version {_v} of the License, or (at your option) any later version",
        f"{_FREE} {_name} {_BY}, version {_v} of the License",
        f"{_FREE} {_name}, version {_v}, {_BY}",
        f"{_FREE} {_name} version {_v} {_BY}",
    ]
NOTICES["AGPL-3.0"] += [
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation "
    "with the community in the case of network server software"
]
NOTICES["MIT"] += [
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
]
NOTICES["BSD-3-Clause"] += [
    f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
]
NOTICES["ISC"] += [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies"
]
NOTICES["Unlicense"] += [
    "This is free and unencumbered software released into the public domain",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means",
]
NOTICES["CC0-1.0"] += [
    "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "has waived all copyright and related or neighboring rights to this work",
]
NOTICES["BSL-1.0"] += [
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
]
NOTICES["Zlib"] += [
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
    "the following restrictions"
]
NOTICES["Apache-2.0"] += [
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
]


def bodies() -> dict[str, str]:
    """License id: its whole text."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
