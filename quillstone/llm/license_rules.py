"""The signatures of the licence scan: (label, priority, keyword, pattern).

Patterns match the normalised text: ASCII letters lower-cased, words parted by one space, a space at either end.
Lower priority numbers win. A pattern runs only where its keyword occurs. The three base labels
(cc-by, gpl, reserved) come from fixed phrases, whatever the signatures find.
"""

from __future__ import annotations

Rule = tuple[str, int, str, str]

V = r"(?: version| v)?"


def _versions(label: str, name: str, keyword: str, versions: list[str], priority: int = 20) -> list[Rule]:
    """A signature for each version, and one for the name with another version or none."""
    rules = []
    for version in versions:
        parts = r" ".join(version.split("."))
        only = "" if version.count(".") else r"(?: 0)?"
        rules.append((f"{label}-{version}", priority, keyword, rf" {name}{V} {parts}{only}(?= )(?! [0-9])"))
        rules.append((f"{label}-{version}", priority, keyword, rf" {name}{V}{parts.replace(' ', ' ?')}(?= )") if " " in parts else
                     (f"{label}-{version}", priority, keyword, rf" {name} v{parts}{only}(?= )"))
    rules.append((label, priority + 20, keyword, rf" {name}(?= )"))
    return rules


def _named(label: str, keyword: str, *patterns: str, priority: int = 30) -> list[Rule]:
    return [(label, priority, keyword, f" {pattern}(?= )") for pattern in patterns]


RULES: list[Rule] = []

# the GNU family
RULES += _versions("agpl", r"(?:gnu )?affero general public licen[sc]e(?: agpl)?", "affero", ["1.0", "2.0", "3.0"], 10)
RULES += _versions("agpl", r"agpl", "agpl", ["1.0", "3.0"], 12)
RULES += _versions("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)?", "general public", ["2.0", "2.1", "3.0"], 10)
RULES += _versions("lgpl", r"lgpl", "lgpl", ["2.0", "2.1", "3.0"], 12)
RULES += _versions("gpl", r"(?:gnu )?general public licen[sc]e(?: gpl)?", "general public", ["1.0", "2.0", "3.0"], 16)
RULES += _versions("gpl", r"(?:gnu )?gpl", "gpl", ["1.0", "2.0", "3.0"], 18)
RULES += [
    ("gpl-3.0", 15, "general public", r" (?:gnu )?general public licen[sc]e(?: gpl)? version 3(?= )(?! [0-9])"),
    ("gpl-2.0", 15, "general public", r" (?:gnu )?general public licen[sc]e(?: gpl)? version 2(?= )(?! [0-9])"),
    ("gpl-3.0-or-later", 8, "any later version", r" general public licen[sc]e(?: gpl)? (?:as published by the free software foundation )?either version 3(?: of the licen[sc]e)? or (?:at your option )?any later version(?= )"),
    ("gpl-2.0-or-later", 8, "any later version", r" general public licen[sc]e(?: gpl)? (?:as published by the free software foundation )?either version 2(?: of the licen[sc]e)? or (?:at your option )?any later version(?= )"),
    ("gpl-3.0-or-later", 9, "gpl", r" gpl(?: v)? ?3 ?(?:0 )?(?:or later|plus)(?= )"),
    ("gpl-2.0-or-later", 9, "gpl", r" gpl(?: v)? ?2 ?(?:0 )?(?:or later|plus)(?= )"),
    ("gpl-3.0", 14, "gplv3", r" gplv3(?= )"), ("gpl-2.0", 14, "gplv2", r" gplv2(?= )"),
    ("lgpl-3.0", 14, "lgplv3", r" lgplv3(?= )"), ("lgpl-2.1", 14, "lgplv2", r" lgplv2 1(?= )"), ("agpl-3.0", 14, "agplv3", r" agplv3(?= )"),
]
RULES += _versions("gfdl", r"(?:gnu )?free documentation licen[sc]e(?: gfdl)?", "free documentation", ["1.1", "1.2", "1.3"])
RULES += _named("gfdl", "gfdl", "gfdl")
RULES += _named("gpl-classpath-exception", "classpath exception", r"classpath exception", priority=12)
RULES += _named("gpl-linking-exception", "linking exception", r"(?:gpl |gcc runtime library )?linking exception", priority=12)

# permissive
RULES += _versions("apache", r"apache(?: software)? licen[sc]e", "apache", ["1.0", "1.1", "2.0"], 16)
RULES += [("apache-2.0", 15, "apache", r" apache 2(?: 0)?(?: licen[sc]ed?)?(?= )(?! [0-9])"), ("apache-2.0", 14, "apache org licenses", r" apache org licenses licen[sc]e 2 0(?= )")]
RULES += _named("mit", "mit licen", r"mit licen[sc]ed?")
RULES += _named("mit", "mit x11 licen", r"(?:under the )?mit x11 licen[sc]e")
RULES += _named("mit", "expat", r"expat licen[sc]e", r"mit expat")
RULES += _named("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", priority=15)
RULES += _named("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?", priority=15)
RULES += _named("x11", "x11 licen", r"x11 licen[sc]e")
RULES += _named("isc", "isc licen", r"isc licen[sc]ed?")
RULES += _named("isc", "permission to use copy modify and or distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee", priority=15)
for count, word in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
    RULES += _named(f"bsd-{count}-clause", "bsd", rf"bsd {count} clause(?: licen[sc]e)?", rf"(?:{count}|{word}) clause bsd(?: licen[sc]e)?", rf"bsd licen[sc]e {count} clause", priority=15)
RULES += _named("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd(?: licen[sc]e)?", priority=16)
RULES += _named("bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd(?: licen[sc]e)?", priority=16)
RULES += _named("bsd-0-clause", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?", priority=15)
RULES += _named("bsd", "bsd", r"bsd(?: style)? licen[sc]ed?", priority=40)
RULES += _named("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", priority=35)
RULES += _named("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote products derived from this software", priority=25)
RULES += _named("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e")
RULES += _named("libpng", "libpng", r"libpng licen[sc]e(?: version 2)?")
RULES += _named("unlicense", "unlicense", r"(?:the )?unlicense")
RULES += _named("wtfpl", "wtfpl", r"wtfpl")
RULES += _named("wtfpl", "do what the fuck", r"do what the fuck you want to public licen[sc]e")
RULES += _versions("bsl", r"boost software licen[sc]e", "boost software", ["1.0"])
RULES += _versions("artistic", r"artistic licen[sc]e", "artistic licen", ["1.0", "2.0"])
RULES += _versions("python", r"(?:python|psf) (?:software foundation )?licen[sc]e(?: agreement)?", "licen", ["2.0"], 25)
RULES += _versions("php", r"php licen[sc]e", "php licen", ["3.0", "3.01"])
RULES += _named("ruby", "ruby licen", r"ruby licen[sc]e")
RULES += _named("openssl", "openssl licen", r"openssl licen[sc]e")
RULES += _named("postgresql", "postgresql licen", r"postgresql licen[sc]e")
RULES += _named("curl", "curl licen", r"curl licen[sc]e")
RULES += _named("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e")
RULES += _versions("zpl", r"zope public licen[sc]e", "zope public", ["1.1", "2.0", "2.1"])
RULES += _named("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[sc]e", r"w3c licen[sc]e")
RULES += _named("unicode", "unicode", r"unicode(?: inc)? licen[sc]e agreement", r"unicode licen[sc]e")
RULES += _named("icu", "icu licen", r"icu licen[sc]e")
RULES += _versions("afl", r"academic free licen[sc]e", "academic free", ["1.1", "1.2", "2.0", "2.1", "3.0"])
RULES += _versions("ecl", r"educational community licen[sc]e", "educational community", ["1.0", "2.0"])
RULES += _named("hpnd", "historical permission", r"historical permission notice and disclaimer")
RULES += _named("upl", "universal permissive", r"universal permissive licen[sc]e")
RULES += _named("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)(?: v2)?")
RULES += _named("blue-oak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?")
RULES += _named("beerware", "beerware", r"beerware(?: licen[sc]e)?")
RULES += _named("fair", "fair licen", r"fair licen[sc]e")
RULES += _named("ftl", "freetype", r"freetype(?: project)? licen[sc]e")
RULES += _named("ijg", "independent jpeg group", r"independent jpeg group licen[sc]e")
RULES += _named("tcl", "tcl tk licen", r"tcl tk licen[sc]e")
RULES += _named("vim", "vim licen", r"vim licen[sc]e")
RULES += _named("json", "good not evil", r"the software shall be used for good not evil")

# weak copyleft
RULES += _versions("mpl", r"mozilla public licen[sc]e(?: mpl)?", "mozilla public", ["1.0", "1.1", "2.0"])
RULES += _versions("mpl", r"mpl", " mpl", ["1.0", "1.1", "2.0"], 22)[:-1]
RULES += _versions("epl", r"eclipse public licen[sc]e(?: epl)?", "eclipse public", ["1.0", "2.0"])
RULES += _versions("edl", r"eclipse distribution licen[sc]e", "eclipse distribution", ["1.0"])
RULES += _versions("cddl", r"common development and distribution licen[sc]e(?: cddl)?", "common development", ["1.0", "1.1"])
RULES += _named("cddl", "cddl", r"cddl")
RULES += _versions("cpl", r"common public licen[sc]e", "common public", ["1.0"])
RULES += _versions("cpal", r"common public attribution licen[sc]e", "common public", ["1.0"], 15)
RULES += _versions("eupl", r"european union public licen[sc]e(?: eupl)?", "european union public", ["1.0", "1.1", "1.2"])
RULES += _named("eupl", "eupl", r"eupl")
RULES += _versions("osl", r"open software licen[sc]e", "open software licen", ["1.0", "2.0", "2.1", "3.0"])
RULES += _named("ms-pl", "microsoft public", r"microsoft public licen[sc]e(?: ms pl)?")
RULES += _named("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e(?: ms rl)?")
RULES += _versions("apsl", r"apple public source licen[sc]e", "apple public source", ["1.0", "1.1", "2.0"])
RULES += _versions("npl", r"netscape public licen[sc]e", "netscape public", ["1.0", "1.1"])
RULES += _versions("ipl", r"ibm public licen[sc]e", "ibm public", ["1.0"])
RULES += _versions("qpl", r"q public licen[sc]e", "q public", ["1.0"])
RULES += _named("sleepycat", "sleepycat", r"sleepycat licen[sc]e")
RULES += _named("sissl", "sun industry standards", r"sun industry standards source licen[sc]e")
RULES += _versions("lppl", r"latex project public licen[sc]e", "latex project public", ["1.0", "1.1", "1.2", "1.3"])
RULES += _versions("ofl", r"(?:sil )?open font licen[sc]e", "open font", ["1.0", "1.1"])
RULES += _versions("cecill", r"cecill(?: free software licen[sc]e agreement)?", "cecill", ["1.0", "2.0", "2.1"])
RULES += _versions("rpl", r"reciprocal public licen[sc]e", "reciprocal public", ["1.1", "1.5"])
RULES += _named("odbl", "open database licen", r"open database licen[sc]e(?: odbl)?")
RULES += _named("odc-by", "open data commons", r"open data commons attribution licen[sc]e")
RULES += _named("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", r"open data commons public domain dedication(?: and licen[sc]e)?", priority=20)

# source available, model and data licences
RULES += _named("sspl", "server side public", r"server side public licen[sc]e(?: v1)?")
RULES += _versions("busl", r"business source licen[sc]e", "business source", ["1.0", "1.1"])
RULES += _versions("elastic", r"elastic licen[sc]e", "elastic licen", ["1.0", "2.0"])
RULES += _named("commons-clause", "commons clause", r"commons clause")
RULES += _named("confluent", "confluent community", r"confluent community licen[sc]e")
RULES += _versions("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e", "polyform", ["1.0.0"])
RULES += _named("openrail", "openrail", r"(?:bigscience |creativeml |big code )?openrail(?: m)?(?: licen[sc]e)?")
RULES += _named("openrail", "responsible ai licen", r"responsible ai licen[sc]e")
RULES += _named("llama", "community licen", r"llama (?:[23] ?(?:[123] )?)?community licen[sc]e(?: agreement)?")

# creative commons: the longer element lists come first
for elements, words in (
    ("by-nc-sa", r"attribution non ?commercial share ?alike"), ("by-nc-nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", r"attribution non ?commercial"), ("by-sa", r"attribution share ?alike"), ("by-nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by", r"attribution"),
):
    order = 4 + 4 * (3 - elements.count("-"))
    short = " ".join(elements.split("-"))
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        number = " ".join(version.split("."))
        RULES.append((f"cc-{elements}-{version}", order, " cc ", rf" cc {short} {number}(?= )"))
        RULES.append((f"cc-{elements}-{version}", order, "creative commons", rf" creative commons {words} {number}(?= )"))
        RULES.append((f"cc-{elements}-{version}", order, "creativecommons org", rf" creativecommons org licenses {short} {number}(?= )"))
    RULES.append((f"cc-{elements}", order + 20, " cc ", rf" cc {short}(?= )"))
    RULES.append((f"cc-{elements}", order + 20, "creative commons", rf" creative commons {words}(?= )"))
RULES += _named("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?")
RULES += _named("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", priority=10)
RULES += _named("cc-pd-mark", "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?")
RULES += _named("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?", priority=60)

# notices
RULES += _named("reserved", "reserved", r"all rights (?:are )?reserved", priority=50)
RULES += _named("some-reserved", "rights reserved", r"some rights reserved", priority=50)
RULES += _named("proprietary", "proprietary", r"proprietary and confidential", r"confidential and proprietary", r"proprietary licen[sc]e")
RULES += _named("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", r"in the public domain")
RULES += _named("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", priority=70)
RULES += _named("do-not-distribute", "not be reproduced", r"may not be reproduced(?: or distributed)?(?: in any form)?")
RULES += _named("do-not-distribute", "distribute", r"do not (?:copy or )?distribute")
RULES += _named("permission-required", "written permission", r"without (?:the )?(?:prior |express )*written permission")
RULES += _named("eula", "end user licen", r"end user licen[sc]e agreement")
RULES += _named("non-commercial", "commercial use", r"(?:for )?non ?commercial use only", r"not for commercial use")
RULES += _named("spdx", "spdx license identifier", r"spdx license identifier [a-z0-9]+(?: [0-9]+)*", priority=80)
