"""Signature rules of the license scan.

A rule is a regular expression over normalised text: words of a-z, 0-9 and characters
beyond ASCII, one space between them. ``LICENSES`` is written by hand: for each label
the ways its name is written, its identifier, and its address. Families with versions
are spelled out by ``_families``. Each license gives up to four rules, in order of
priority: an identifier tag, a grant ("licensed under ..."), an address, a name. General
phrases come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TAG, GRANT, ADDRESS, NAME, GENERAL = range(5)
#: How sure a kind of rule is that a license applies to the text.
SURE = {TAG: 1.0, GRANT: 0.95, ADDRESS: 0.85, NAME: 0.7, GENERAL: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: int
    pattern: str
    #: One of these words or phrases stands in every text that the pattern matches.
    keywords: tuple[str, ...]


#: label, name, keywords of the name, identifier (None: none), address (None: none)
LICENSES = [
    ("mit", r"(?:mit|expat) (?:open source )?licen[sc]e", ("mit", "expat"), r"mit", r"opensource org licenses mit"),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e", ("mit",), r"mit 0", r"opensource org licenses mit 0"),
    ("isc", r"isc (?:open source )?licen[sc]e|internet systems consortium licen[sc]e", ("isc", "consortium"), r"isc", r"opensource org licenses isc"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)?|freebsd licen[sc]e",
     ("bsd", "freebsd"), r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd(?: style)? licen[sc]e|bsd (?:3|three) clause(?: licen[sc]e)?",
     ("bsd",), r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd(?: style)? licen[sc]e|bsd (?:4|four) clause(?: licen[sc]e)?",
     ("bsd",), r"bsd 4 clause", None),
    ("0bsd", r"(?:zero clause|free public) bsd licen[sc]e|bsd zero clause licen[sc]e|0bsd", ("bsd", "0bsd"), r"0bsd", r"opensource org licenses 0bsd"),
    ("bsd", r"bsd(?: style)? licen[sc]e|berkeley software distribution licen[sc]e", ("bsd", "berkeley"), None, None),
    ("apache-1.0", r"apache (?:software )?licen[sc]e (?:version |v ?)?1 0", ("apache",), r"apache 1 0", r"apache org licenses license 1 0"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e (?:version |v ?)?1 1", ("apache",), r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", r"apache (?:software |public )?licen[sc]e (?:version |v ?)?2(?: 0)?|apache 2(?: 0)? licen[sc]e|asl 2 0", ("apache", "asl"),
     r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache", r"apache (?:software )?licen[sc]e", ("apache",), None, r"apache org licenses"),
    ("mpl-1.0", r"mozilla public licen[sc]e (?:version |v ?)?1 0|mpl (?:version |v ?)?1 0", ("mozilla", "mpl"), r"mpl 1 0", r"mozilla org mpl 1 0"),
    ("mpl-1.1", r"mozilla public licen[sc]e (?:version |v ?)?1 1|mpl (?:version |v ?)?1 1", ("mozilla", "mpl"), r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?|mpl (?:version |v ?)?2 0", ("mozilla", "mpl"), r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("mpl", r"mozilla public licen[sc]e", ("mozilla",), None, r"mozilla org mpl"),
    ("epl-1.0", r"eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?", ("eclipse",), r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?", ("eclipse",), r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("edl-1.0", r"eclipse distribution licen[sc]e(?: (?:version |v ?)?1 0)?", ("eclipse",), None, r"eclipse org (?:org )?documents edl v10"),
    ("cddl-1.0", r"common development and distribution licen[sc]e(?: (?:version |v ?)?1 0)?|cddl(?: 1 0)?", ("distribution", "cddl"), r"cddl 1 0", None),
    ("cddl-1.1", r"common development and distribution licen[sc]e (?:version |v ?)?1 1|cddl 1 1", ("distribution", "cddl"), r"cddl 1 1", None),
    ("cpl-1.0", r"common public licen[sc]e(?: (?:version |v ?)?1 0)?", ("common",), r"cpl 1 0", None),
    ("cpal-1.0", r"common public attribution licen[sc]e(?: (?:version |v ?)?1 0)?", ("attribution",), r"cpal 1 0", None),
    ("bsl-1.0", r"boost software licen[sc]e(?: (?:version |v ?)?1 0)?", ("boost",), r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", r"business source licen[sc]e(?: (?:version |v ?)?1 1)?", ("business",), r"busl 1 1", None),
    ("artistic-1.0", r"artistic licen[sc]e (?:version |v ?)?1 0", ("artistic",), r"artistic 1 0", None),
    ("artistic-2.0", r"artistic licen[sc]e (?:version |v ?)?2 0", ("artistic",), r"artistic 2 0", r"opensource org licenses artistic 2 0"),
    ("artistic", r"(?:clarified )?artistic licen[sc]e", ("artistic",), None, None),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", ("zlib",), r"zlib", r"opensource org licenses zlib"),
    ("libpng", r"(?:libpng|png reference library) licen[sc]e", ("libpng", "png"), r"libpng(?: 2 0)?", None),
    ("ijg", r"independent jpeg group(?: s)? licen[sc]e", ("jpeg",), r"ijg", None),
    ("unlicense", r"the unlicen[sc]e|unlicen[sc]e licen[sc]e", ("unlicense", "unlicence"), r"unlicense", r"unlicense org"),
    ("wtfpl", r"do what the f\w+ you want to public licen[sc]e|wtfpl", ("want", "wtfpl"), r"wtfpl", r"wtfpl net"),
    ("python-2.0", r"python software foundation licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?|psf licen[sc]e", ("python", "psf"), r"(?:python|psf) 2 0", r"python org psf"),
    ("ruby", r"ruby(?: s)? licen[sc]e", ("ruby",), r"ruby", None),
    ("php-3.01", r"php licen[sc]e(?: (?:version |v ?)?3 01)?", ("php",), r"php 3 01", r"php net license"),
    ("perl", r"same terms as perl(?: 5)?(?: itself)?|perl licen[sc]e", ("perl",), None, None),
    ("postgresql", r"postgresql licen[sc]e", ("postgresql",), r"postgresql", r"opensource org licenses postgresql"),
    ("openssl", r"openssl licen[sc]e", ("openssl",), r"openssl", None),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?", ("font",), r"ofl 1 1", r"scripts sil org ofl"),
    ("afl-3.0", r"academic free licen[sc]e(?: (?:version |v ?)?3 0)?", ("academic",), r"afl 3 0", None),
    ("osl-3.0", r"open software licen[sc]e(?: (?:version |v ?)?3 0)?", ("software",), r"osl 3 0", None),
    ("ms-pl", r"microsoft public licen[sc]e|ms pl licen[sc]e", ("microsoft", "ms"), r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", ("microsoft",), r"ms rl", r"opensource org licenses ms rl"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", ("ncsa",), r"ncsa", r"opensource org licenses ncsa"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", ("w3c",), r"w3c", None),
    ("x11", r"x11 licen[sc]e|x consortium licen[sc]e", ("x11", "consortium"), r"x11", None),
    ("curl", r"curl licen[sc]e", ("curl",), r"curl", None),
    ("vim", r"vim licen[sc]e", ("vim",), r"vim", None),
    ("beerware", r"beer ?ware licen[sc]e", ("beer", "beerware"), r"beerware", None),
    ("json", r"json licen[sc]e|shall be used for good not evil", ("json", "evil"), r"json", None),
    ("upl-1.0", r"universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?", ("permissive",), r"upl 1 0", None),
    ("ecl-2.0", r"educational community licen[sc]e(?: (?:version |v ?)?2 0)?", ("educational",), r"ecl 2 0", None),
    ("eupl-1.1", r"european union public licen[sc]e (?:version |v ?)?1 1|eupl (?:v ?)?1 1", ("european", "eupl"), r"eupl 1 1", None),
    ("eupl-1.2", r"european union public licen[sc]e(?: (?:version |v ?)?1 2)?|eupl(?: (?:v ?)?1 2)?", ("european", "eupl"), r"eupl 1 2", None),
    ("cecill-2.1", r"cecill(?: licen[sc]e)?(?: (?:version |v ?)?2 1)?", ("cecill",), r"cecill 2 1", r"cecill info"),
    ("mulanpsl-2.0", r"mulan permissive software licen[sc]e(?: (?:version |v ?)?2)?", ("mulan",), r"mulanpsl 2 0", None),
    ("sspl-1.0", r"server side public licen[sc]e(?: (?:version |v ?)?1)?", ("server",), r"sspl 1 0", None),
    ("elastic-2.0", r"elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", ("elastic",), r"elastic 2 0", None),
    ("commons-clause", r"commons clause(?: licen[sc]e condition)?", ("commons",), None, r"commonsclause com"),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield) licen[sc]e", ("polyform",), r"polyform \w+", r"polyformproject org"),
    ("odbl-1.0", r"open database licen[sc]e|odbl", ("database", "odbl"), r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e|odc by", ("data", "odc"), r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e|pddl", ("dedication", "pddl"), r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: licen[sc]e)?", ("cc0", "zero"), r"cc0 1 0", r"creativecommons org publicdomain zero"),
    ("cc-pdm", r"creative commons public domain mark|public domain mark 1 0", ("mark",), None, r"creativecommons org publicdomain mark"),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: [ms])? licen[sc]e|responsible ai licen[sc]e", ("openrail", "rail", "responsible"), None, None),
    ("llama-community", r"llama (?:2 |3 |3 1 )?community licen[sc]e(?: agreement)?", ("llama",), None, None),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v ?)?1 3)?|gfdl", ("documentation", "gfdl"), r"gfdl 1 3", r"gnu org licenses fdl"),
    ("ogl-uk-3.0", r"(?:uk )?open government licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?", ("government",), r"ogl uk 3 0", r"nationalarchives gov uk doc open government licence"),
]

#: General phrases, last in priority.
PHRASES = [
    ("public-domain", r"(?:in|into|to) the public domain|public domain dedication", ("domain",)),
    ("all-rights-reserved", r"all rights reserved", ("rights",)),
    ("proprietary", r"proprietary (?:and confidential|licen[sc]e|software)", ("proprietary",)),
    ("no-commercial-use", r"(?:for )?non ?commercial use only|no commercial use", ("commercial", "noncommercial")),
    ("see-license-file", r"see (?:the )?(?:accompanying )?licen[sc]e file|licen[sc]e file (?:for|in) (?:details|the root)", ("license", "licence")),
    ("as-is", r"provided as is without warranty", ("warranty",)),
    ("redistribution", r"redistribution and use in source and binary forms", ("redistribution",)),
    ("permission-granted", r"permission is hereby granted free of charge", ("permission",)),
    ("free-software", r"this (?:program|library) is free software", ("free",)),
    ("open-source", r"open source licen[sc]e", ("source",)),
]


def _families() -> list[tuple]:
    """Licenses with versions and variants, by one pattern per family."""
    out = []
    gnu = [("gpl", r"general public licen[sc]e|gpl", "gpl"), ("lgpl", r"(?:lesser|library) general public licen[sc]e|lgpl", "lgpl"),
           ("agpl", r"affero general public licen[sc]e|agpl", "agpl")]
    for stem, name, word in gnu:
        general = ("general", word)
        for version in (["1", "2", "3"] if stem == "gpl" else ["2", "2.1", "3"] if stem == "lgpl" else ["1", "3"]):
            v = version.replace(".", " ") + (r"(?: 0)?" if "." not in version else "")
            # glued forms such as gplv3 are words of their own
            glued = rf"{word}v?{version[0]}" + (" 1" if "." in version else "(?: 0)?")
            full = rf"(?:gnu )?(?:(?:{name}) (?:version |v ?)?{v}|{glued})"
            words = (*general, f"{word}{version[0]}", f"{word}v{version[0]}")
            out.append((f"{stem}-{version}-or-later", rf"{full} or (?:any |at your option any )?later(?: version)?", words, rf"{stem} {v} or later",
                        None))
            out.append((f"{stem}-{version}", rf"{full}(?: only)?(?: licen[sc]e)?", words, rf"{stem} {v}(?: only)?",
                        rf"gnu org licenses (?:old licenses )?{stem} {v}"))
        out.append((stem, rf"gnu (?:{name})|(?:{name}) licen[sc]e" if stem == "gpl" else rf"(?:gnu )?(?:{name})", general, None,
                    rf"gnu org (?:licenses|copyleft) {stem}"))
    parts = [("by", "attribution"), ("by-sa", r"attribution share ?alike"), ("by-nd", r"attribution no ?deriv\w*"),
             ("by-nc", r"attribution non ?commercial"), ("by-nc-sa", r"attribution non ?commercial share ?alike"),
             ("by-nc-nd", r"attribution non ?commercial no ?deriv\w*")]
    for code, words in parts:
        short = code.replace("-", " ")
        name = rf"(?:creative commons|cc) (?:{short}|{words})(?: licen[sc]e)?(?: (?:version |v ?)?[1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"
        out.append((f"cc-{code}", name, ("creative", "cc"), rf"cc {short} [1-4] [05]", rf"creativecommons org licenses {short}(?: [1-4] [05])?"))
    out.append(("cc", r"creative commons licen[sc]e", ("creative",), None, r"creativecommons org licenses"))
    return out


#: What stands before a name where a license is granted.
GRANTED = (r"(?:(?:dual )?licen[sc]ed|released|distributed|available|published|provided|shared|open sourced) (?:to you )?"
           r"(?:under|according to|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: either)?(?: the| a| an)?(?: gnu)? ")


def build() -> list[Rule]:
    """All rules in order: by kind, then as they are written."""
    rules = []
    for label, name, words, tag, address in [*LICENSES, *_families()]:
        if tag:
            rules.append(Rule(label, TAG, rf"spdx licen[sc]e identifier (?:{tag})", ("spdx",)))
        rules.append(Rule(label, GRANT, rf"{GRANTED}(?:{name})", words))
        if address:
            rules.append(Rule(label, ADDRESS, address, tuple({"opensource": ("opensource",)}.get(address.split(" ")[0], (address.split(" ")[0],)))))
        rules.append(Rule(label, NAME, name, words))
    rules += [Rule(label, GENERAL, pattern, words) for label, pattern, words in PHRASES]
    return sorted(rules, key=lambda r: r.kind)


def compiled(pattern: str) -> re.Pattern:
    """Matches of whole words only."""
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")
