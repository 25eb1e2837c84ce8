"""Signature rules of the license scan, as data.

A rule is (label, kind, keyword, pattern).  Patterns are read over a text's
words, lower-cased and joined by single spaces, and match whole words; the
keyword is a literal part of every match and gates the rule.  Kinds, in order
of priority: ``tag`` (machine-readable identifier), ``grant`` (a sentence of
the license or of its notice), ``name`` (the full name), ``short`` (an
abbreviation) and ``hint`` (words that point at some license).
"""

from __future__ import annotations

KINDS = ("tag", "grant", "name", "short", "hint")
CONFIDENCE = {"tag": 1.0, "grant": 0.95, "name": 0.9, "short": 0.7, "hint": 0.4}

# Base phrases: counted at every place, their labels always stay.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def _version(v: str, optional: str = r"(?:v|version |ver |v )?") -> str:
    """Words of a version number, with or without the word before it."""
    return optional + v.replace(".", " ")


def _creative_commons() -> list[tuple]:
    """Six kinds, five versions, tag, name and short form of each."""
    kinds = {"by": "attribution", "by sa": "attribution share ?alike",
             "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
             "by nc": "attribution non ?commercial",
             "by nc sa": "attribution non ?commercial share ?alike",
             "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    out = []
    for short, long in kinds.items():
        label = "cc-" + short.replace(" ", "-")
        out.append((label, "name", "creative commons", f"creative commons {long}(?: licen[sc]e)?"))
        out.append((label, "short", f"cc {short}", f"cc {short}"))
        out.append((label, "grant", f"licenses {short}",
                    f"creativecommons org licenses {short}(?: [1-4] [05])?(?: [a-z]{{2}})?"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            words = v.replace(".", " ")
            one = f"{label}-{v}"
            out.append((one, "tag", f"cc {short} {words}",
                        f"spdx license identifier cc {short} {words}"))
            out.append((one, "name", "creative commons",
                        f"creative commons {long} {words}(?: international| unported| generic)?"
                        "(?: public)?(?: licen[sc]e)?"))
            out.append((one, "short", f"cc {short} {words}", f"cc {short} {words}"))
    return out


def _gnu() -> list[tuple]:
    """Three families, their versions, "only" and "or later" forms."""
    families = {"gpl": ("general public licen[sc]e", ("1.0", "2.0", "3.0")),
                "lgpl": ("(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0")),
                "agpl": ("affero general public licen[sc]e", ("1.0", "3.0"))}
    out = []
    for short, (name, versions) in families.items():
        out.append((short, "name", "public licen", f"(?:the )?gnu {name}"))
        out.append((short, "hint", short, f"(?:gnu )?{short}(?: licen[sc]ed?)?"))
        for v in versions:
            major = v.removesuffix(".0")
            words = v.replace(".", " ")
            number = words if v != f"{major}.0" else f"{major}(?: 0)?"
            for tail, form in (("", ""), ("-only", " only"), ("-or-later", " or later")):
                out.append((f"{short}-{v}{tail}", "tag", f"{short} {words}{form}",
                            f"spdx license identifier {short} {words}{form}"))
            out.append((f"{short}-{v}", "name", "public licen",
                        f"(?:gnu )?{name}(?: as published by the free software foundation)?"
                        f"(?: either)? (?:v|version |ver ){number}(?: of the license)?"))
            out.append((f"{short}-{v}-or-later", "grant", "later version",
                        f"(?:gnu )?{name}(?: as published by the free software foundation)?"
                        f"(?: either)? (?:v|version ){number}(?: of the license)? or "
                        "(?:at your option )?any later version"))
            out.append((f"{short}-{v}", "short", short,
                        f"(?:gnu )?{short} ?(?:v|version |v )?{number}"))
            out.append((f"{short}-{v}-or-later", "short", f"{short}v{major.replace('.', ' ')}",
                        f"{short}v{number} (?:or later|plus)"))
    return out


def _versioned() -> list[tuple]:
    """Licenses with numbered versions: (tag, name, keyword, versions)."""
    families = (
        ("apache", "apache(?: software)? licen[sc]e", "apache", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla public licen[sc]e", "mozilla", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse public licen[sc]e", "eclipse", ("1.0", "2.0")),
        ("eupl", "european union public licen[sc]e", "european union", ("1.0", "1.1", "1.2")),
        ("cddl", "common development and distribution licen[sc]e", "common development",
         ("1.0", "1.1")),
        ("cpl", "common public licen[sc]e", "common public", ("1.0",)),
        ("artistic", "artistic licen[sc]e", "artistic", ("1.0", "2.0")),
        ("bsl", "boost software licen[sc]e", "boost software", ("1.0",)),
        ("ofl", "sil open font licen[sc]e", "open font", ("1.0", "1.1")),
        ("afl", "academic free licen[sc]e", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("osl", "open software licen[sc]e", "open software", ("1.0", "2.0", "2.1", "3.0")),
        ("odbl", "open database licen[sc]e", "open database", ("1.0",)),
        ("gfdl", "free documentation licen[sc]e", "free documentation", ("1.1", "1.2", "1.3")),
        ("lppl", "latex project public licen[sc]e", "latex project", ("1.0", "1.1", "1.2", "1.3")),
        ("php", "php licen[sc]e", "php licen", ("3.0", "3.01")),
        ("python", "python(?: software foundation)? licen[sc]e", "python", ("2.0",)),
        ("zpl", "zope public licen[sc]e", "zope", ("1.1", "2.0", "2.1")),
        ("cecill", "cecill(?: free software)? licen[sc]e(?: agreement)?", "cecill",
         ("1.0", "1.1", "2.0", "2.1")),
        ("mulan", "mulan permissive software licen[sc]e", "mulan", ("1.0", "2.0")),
        ("busl", "business source licen[sc]e", "business source", ("1.1",)),
        ("sspl", "server side public licen[sc]e", "server side", ("1.0",)),
        ("elastic", "elastic licen[sc]e", "elastic", ("1.0", "2.0")),
    )
    out = []
    for tag, name, keyword, versions in families:
        out.append((tag, "name", keyword, f"(?:the )?{name}"))
        out.append((tag, "grant", keyword, f"licensed under (?:the )?(?:terms of the )?{name}"))
        for v in versions:
            words = v.replace(".", " ")
            number = words.removesuffix(" 0") + "(?: 0)?" if words.endswith(" 0") else words
            one = f"{tag}-{v}"
            out.append((one, "tag", f"{tag} {words}", f"spdx license identifier {tag} {words}"))
            out.append((one, "name", keyword, f"(?:the )?{name} {_version(number)}"))
            out.append((one, "grant", keyword,
                        f"licensed under (?:the )?(?:terms of the )?{name} {_version(number)}"))
            if tag not in ("php", "python", "elastic"):
                out.append((one, "short", "licen",
                            f"licen[sc]ed? (?:under )?(?:the )?{tag} {_version(words)}"
                            f"|{tag} {_version(words)} licen[sc]ed?"))
    return out


def _plain() -> list[tuple]:
    """Licenses known by sentences and names of their own."""
    return [
        ("mit", "tag", "identifier mit", "spdx license identifier mit"),
        ("mit", "name", "mit licen", "(?:the )?mit licen[sc]e"),
        ("mit", "grant", "mit licen", "(?:released|licensed|distributed) under (?:the )?mit licen[sc]e"),
        ("mit", "grant", "permission is hereby granted",
         "permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit", "hint", "expat", "expat licen[sc]e"),
        ("x11", "name", "x11 licen", "x11 licen[sc]e"),
        ("isc", "tag", "identifier isc", "spdx license identifier isc"),
        ("isc", "name", "isc licen", "isc licen[sc]e"),
        ("isc", "grant", "permission to use copy modify",
         "permission to use copy modify and or distribute this software for any purpose"),
        ("0bsd", "tag", "identifier 0bsd", "spdx license identifier 0bsd"),
        ("bsd", "name", "bsd", "bsd(?: style)? licen[sc]e"),
        ("bsd", "grant", "redistribution and use",
         "redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-2-clause", "tag", "bsd 2 clause", "spdx license identifier bsd 2 clause"),
        ("bsd-2-clause", "name", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?"),
        ("bsd-3-clause", "tag", "bsd 3 clause", "spdx license identifier bsd 3 clause"),
        ("bsd-3-clause", "name", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?"),
        ("bsd-3-clause", "grant", "neither the name",
         "neither the names? of .{1,80}? may be used to endorse or promote products"),
        ("bsd-4-clause", "name", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?"),
        ("bsd-4-clause", "grant", "all advertising materials",
         "all advertising materials mentioning features or use of this software"),
        ("apache-2.0", "grant", "apache org licenses", "apache org licenses license 2 0"),
        ("apache-2.0", "grant", "apache",
         "licensed under the apache license version 2 0 the license"),
        ("mpl-2.0", "grant", "mozilla",
         "subject to the terms of the mozilla public license v 2 0"),
        ("cc0-1.0", "tag", "cc0 1 0", "spdx license identifier cc0 1 0"),
        ("cc0-1.0", "name", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
        ("cc0-1.0", "grant", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
        ("creative-commons", "hint", "creative commons", "creative commons(?: licen[sc]e)?"),
        ("unlicense", "tag", "identifier unlicense", "spdx license identifier unlicense"),
        ("unlicense", "name", "unlicense", "(?:the )?unlicense"),
        ("unlicense", "grant", "unencumbered software",
         "this is free and unencumbered software released into the public domain"),
        ("public-domain", "hint", "public domain", "(?:in|into|to) the public domain"),
        ("public-domain", "grant", "public domain",
         "(?:dedicated|released|placed|donated) (?:in)?to the public domain"),
        ("wtfpl", "short", "wtfpl", "wtfpl"),
        ("wtfpl", "name", "what the fuck", "do what the fuck you want to public licen[sc]e"),
        ("zlib", "tag", "identifier zlib", "spdx license identifier zlib"),
        ("zlib", "name", "zlib", "zlib(?: libpng)? licen[sc]e"),
        ("zlib", "grant", "as is without any express",
         "this software is provided as is without any express or implied warranty"),
        ("libpng", "name", "libpng", "libpng licen[sc]e"),
        ("openssl", "name", "openssl", "openssl licen[sc]e"),
        ("ncsa", "name", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e"),
        ("postgresql", "name", "postgresql", "postgresql licen[sc]e"),
        ("curl", "name", "curl licen", "curl licen[sc]e"),
        ("beerware", "name", "beer", "beer ?ware licen[sc]e"),
        ("json", "grant", "good not evil", "the software shall be used for good not evil"),
        ("unicode", "name", "unicode", "unicode(?: inc)? licen[sc]e agreement"),
        ("w3c", "name", "w3c", "w3c software(?: notice and)? licen[sc]e"),
        ("vim", "name", "vim licen", "vim licen[sc]e"),
        ("ruby", "name", "ruby licen", "ruby licen[sc]e"),
        ("perl", "grant", "perl itself", "same terms as perl itself"),
        ("ms-pl", "name", "microsoft public", "microsoft public licen[sc]e"),
        ("ms-rl", "name", "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
        ("commons-clause", "name", "commons clause", "commons clause(?: licen[sc]e)?"),
        ("ogl-uk", "name", "open government", "open government licen[sc]e(?: v?[123](?: 0)?)?"),
        ("pddl", "name", "public domain dedication", "public domain dedication and licen[sc]e"),
        ("odc-by", "name", "open data commons", "open data commons attribution licen[sc]e"),
        ("proprietary", "grant", "confidential and proprietary",
         "(?:strictly )?confidential and proprietary"),
        ("proprietary", "grant", "without the prior written",
         "may not be (?:copied|reproduced|distributed|used)(?: \\S+){0,8} without the prior written "
         "(?:permission|consent)"),
        ("proprietary", "hint", "proprietary licen", "proprietary licen[sc]e"),
        ("eula", "name", "end user licen", "end user licen[sc]e agreement"),
        ("copyright", "hint", "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
        ("copyright", "hint", "copyright", "copyright (?:c|by)(?: \\S+){1,4}? (?:19|20)\\d\\d"),
        ("licensed-under", "hint", "licensed under", "licensed under(?: the)?(?: terms of)?"),
        ("licensed-under", "hint", "under the terms", "under the terms of (?:the|this) licen[sc]e"),
        ("no-license", "hint", "no licen", "no licen[sc]e (?:is )?granted"),
    ]


def rules() -> list[tuple[str, str, str, str]]:
    """All rules in order: base phrases are among them as ``name`` rules."""
    base = [(label, "name", phrase, phrase) for phrase, label in BASE]
    return base + _creative_commons() + _gnu() + _versioned() + _plain()


# A text without any of these words holds no keyword of any rule.
GATES = ("licen", "copyright", "rights reserved", "cc by", "cc0", "creative commons",
         "creativecommons", "publicdomain", "public domain", "gpl", "bsd", "wtfpl",
         "permission", "redistribution", "neither the name", "all advertising", "apache",
         "libpng", "perl itself", "good not evil", "as is without", "confidential",
         "without the prior", "under the terms", "unencumbered", "commons clause",
         "what the fuck", "later version", "mozilla", "identifier")
