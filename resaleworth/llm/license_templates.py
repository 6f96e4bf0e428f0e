"""Templates of the licence scan: whole texts of common licences, usual notices, names and SPDX tags.

``TEMPLATES`` holds (template, text), first the short ``NOTICES``; whole texts are the files of ``licenses``. ``VERSIONS`` holds the phrases that
a window must have word for word besides its share of the template, as the versions of a licence differ in little else.
"""

from __future__ import annotations

from pathlib import Path

# Usual wordings of licence notices.
_SHORT = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("gpl-3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-short", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("cc0-1.0-name", "CC0 1.0 Universal"),
    ("isc-short", "Licensed under the ISC License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("bsd-short", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("unlicense-short", "This is free and unencumbered software released into the public domain."),
)
_LONGER = (
    ("gpl-2-only-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-1.1-notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("epl-1.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("epl-2.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("apache-2.0-grant", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc0-1.0-notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
)

# GNU notices that differ in the work, the licence and its version.
_GNU = {
    "gpl-1-notice": ("program", "General", "1"), "gpl-2-notice": ("program", "General", "2"),
    "lgpl-2-notice": ("library", "Library General", "2"), "lgpl-2.1-notice": ("library", "Lesser General", "2.1"),
    "lgpl-3-notice": ("program", "Lesser General", "3"), "agpl-3-notice": ("program", "Affero General", "3"),
}
_NAMES = {
    "gpl-1-name": "GNU General Public License version 1", "gpl-2-name": "GNU General Public License version 2", "gpl-3-name": "GNU General Public License version 3",
    "lgpl-2.1-name": "GNU Lesser General Public License version 2.1", "lgpl-3-name": "GNU Lesser General Public License version 3",
    "agpl-3-name": "GNU Affero General Public License version 3", "mpl-1.1-name": "Mozilla Public License Version 1.1", "mpl-2.0-name": "Mozilla Public License Version 2.0",
    "epl-1.0-name": "Eclipse Public License v 1.0", "epl-2.0-name": "Eclipse Public License v 2.0",
}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
_SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "0BSD", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)

_TEXTS = {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _gnu_notice(work: str, kind: str, version: str) -> str:
    return (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License"
        f" as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


NOTICES: tuple[tuple[str, str], ...] = (*_SHORT, *_NAMES.items())
TEMPLATES: tuple[tuple[str, str], ...] = (
    *NOTICES,
    *_LONGER,
    *((name, _gnu_notice(*parts)) for name, parts in _GNU.items()),
    *((f"cc-{kind}-{v}-notice", f"This work is licensed under a Creative Commons {words} {v} {where} License.") for kind, words in _CC.items() for v, where in _CC_VERSIONS.items()),
    *((f"cc-{kind}-4.0-short", f"Licensed under CC {kind.upper()} 4.0.") for kind in _CC if kind != "by-nc"),
    *((f"spdx-{name.lower()}", f"SPDX-License-Identifier: {name}") for name in _SPDX),
    *((f"{name}-text", text) for name, text in _TEXTS.items()),
)

VERSIONS: dict[str, tuple[str, ...]] = {
    "apache-2.0-short": ("license version 2 0",), "apache-2.0-grant": ("license version 2 0",), "cc-by-nc-4.0-short": ("cc by nc 4 0",),
    "gpl-3-short": ("gnu general public license version 3",), "gpl-3-notice": ("the gnu general public license", "3 of the"),
    "gpl-2-only-notice": ("the gnu general public license", "foundation version 2 of the license"),
    "mpl-1.1-notice": ("mozilla public license version 1 1",), "mpl-2.0-notice": ("mozilla public license v 2 0",),
    "epl-1.0-notice": ("eclipse public license v1 0",), "epl-2.0-notice": ("eclipse public license 2 0",), "cc0-1.0-name": ("cc0 1 0 universal",),
    **{name: (f"gnu {kind} public license as", f"either version {version.replace('.', ' ')} of the license") for name, (_, kind, version) in _GNU.items()},
    **{name: (text.replace(".", " "),) for name, text in _NAMES.items()},
    **{f"cc-{kind}-{v}-notice": (f"commons {words} {v} {where} license".replace("-", " ").replace(".", " "),) for kind, words in _CC.items() for v, where in _CC_VERSIONS.items()},
    **{f"cc-{kind}-4.0-short": (f"under cc {kind} 4 0".replace("-", " "),) for kind in _CC},
    **{f"spdx-{name.lower()}": (f"spdx license identifier {name}".replace("-", " ").replace(".", " "),) for name in _SPDX},
    "apache-2.0-text": ("version 2 0 january 2004",), "bsd-3-clause-text": ("endorse or promote products",), "bsl-1.0-text": ("license version 1 0",),
    "cc-by-sa-3.0-text": ("sharealike 3 0 unported",), "cc-by-sa-4.0-text": ("sharealike 4 0 international",), "cc0-1.0-text": ("cc0 1 0 universal",),
    "epl-1.0-text": ("public license v 1 0",), "gfdl-1.2-text": ("version 1 2 november 2002",), "gfdl-1.3-text": ("version 1 3 3 november 2008",),
    "gpl-1.0-text": ("version 1 february 1989",), "gpl-2.0-text": ("gnu general public license version 2 june 1991",), "gpl-3.0-text": ("version 3 29 june 2007",),
    "lgpl-2.0-text": ("gnu library general public license version 2 june 1991",), "lgpl-2.1-text": ("version 2 1 february 1999",),
    "lgpl-3.0-text": ("gnu lesser general public license version 3 29 june 2007",), "mpl-1.1-text": ("mozilla public license version 1 1",), "mpl-2.0-text": ("mozilla public license version 2 0",),
}
