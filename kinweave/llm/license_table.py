"""The signature rules: hand-written regular expressions over words, with the keywords that let them be tried.

A line in brackets opens a group; its rules are tried where one of the words in it occurs. Each of a group's expressions needs one of them. A rule's line is label, priority,
confidence and expression. Texts are lower-case words with one blank between and one at both ends; an expression meets
whole words (a match begins with the blank before its first word and ends before a blank). ``{v}`` stands for an optional word before a number of a version,
``{l}`` for the word license in its spellings, ``{by}`` for what introduces a license.

Priorities: 5 a machine-readable tag, 4 a title with its version, 3 a title or a sentence of the license's own text, 2 a
short name, 1 a general hint.
"""

from __future__ import annotations

from typing import NamedTuple

_LICENSE = ("license", "licence", "licenses", "licences", "lizenz", "licencia", "licença", "licenza")
_MACROS = {
    "{v}": "(?:version |ver |v )?v?",
    "{l}": f"(?:{'|'.join(_LICENSE)})",
    "{by}": "(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered) (?:under|by|subject to)(?: the)?(?: terms of(?: the)?)?",
}

_TABLE = r"""
[spdx]
mit 5 1.0 spdx {l} identifier mit
mit-0 5 1.0 spdx {l} identifier mit 0
apache-2.0 5 1.0 spdx {l} identifier apache 2 0
apache-1.1 5 1.0 spdx {l} identifier apache 1 1
bsd-2-clause 5 1.0 spdx {l} identifier bsd 2 clause
bsd-3-clause 5 1.0 spdx {l} identifier bsd 3 clause
bsd-4-clause 5 1.0 spdx {l} identifier bsd 4 clause
0bsd 5 1.0 spdx {l} identifier 0bsd
gpl-2.0-only 5 1.0 spdx {l} identifier gpl 2 0(?: only)?
gpl-2.0-or-later 5 1.0 spdx {l} identifier gpl 2 0 or later
gpl-3.0-only 5 1.0 spdx {l} identifier gpl 3 0(?: only)?
gpl-3.0-or-later 5 1.0 spdx {l} identifier gpl 3 0 or later
lgpl-2.1-only 5 1.0 spdx {l} identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later 5 1.0 spdx {l} identifier lgpl 2 1 or later
lgpl-3.0-only 5 1.0 spdx {l} identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later 5 1.0 spdx {l} identifier lgpl 3 0 or later
agpl-3.0-only 5 1.0 spdx {l} identifier agpl 3 0(?: only)?
agpl-3.0-or-later 5 1.0 spdx {l} identifier agpl 3 0 or later
mpl-2.0 5 1.0 spdx {l} identifier mpl 2 0
epl-1.0 5 1.0 spdx {l} identifier epl 1 0
epl-2.0 5 1.0 spdx {l} identifier epl 2 0
isc 5 1.0 spdx {l} identifier isc
zlib 5 1.0 spdx {l} identifier zlib
unlicense 5 1.0 spdx {l} identifier unlicense
cc0-1.0 5 1.0 spdx {l} identifier cc0 1 0
cc-by-4.0 5 1.0 spdx {l} identifier cc by 4 0
cc-by-sa-4.0 5 1.0 spdx {l} identifier cc by sa 4 0
cc-by-nc-4.0 5 1.0 spdx {l} identifier cc by nc 4 0
cc-by-nc-sa-4.0 5 1.0 spdx {l} identifier cc by nc sa 4 0
cc-by-nd-4.0 5 1.0 spdx {l} identifier cc by nd 4 0
bsl-1.0 5 1.0 spdx {l} identifier bsl 1 0
artistic-2.0 5 1.0 spdx {l} identifier artistic 2 0
eupl-1.2 5 1.0 spdx {l} identifier eupl 1 2
ofl-1.1 5 1.0 spdx {l} identifier ofl 1 1
cddl-1.0 5 1.0 spdx {l} identifier cddl 1 0
busl-1.1 5 1.0 spdx {l} identifier busl 1 1
proprietary 5 0.9 spdx {l} identifier licenseref(?: [^ ]+)? proprietary
other-spdx 1 0.6 spdx {l} identifier [^ ]+
[{l}]
mit 3 0.95 {by} mit {l}
mit 3 0.95 mit {l} mit
mit 3 0.9 under the mit {l}
mit 2 0.85 the mit {l}
mit 2 0.8 mit {l}
mit 2 0.85 mit style {l}
mit 3 0.9 unter der mit lizenz
mit 3 0.9 bajo la licencia mit
mit-x11 3 0.9 (?:x11 mit|mit x11) {l}
mit 3 0.9 (?:bajo|según) la licencia mit
mit 3 0.9 (?:sous|selon) (?:la )?licence mit
[expat]
mit 2 0.85 expat {l}
mit 2 0.85 expat mit {l}
[{l}]
mit 2 0.75 mit style {l}
[hereby]
mit 3 0.95 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
bsl-1.0 3 0.95 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
ofl-1.1 3 0.95 permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode 3 0.95 permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
other-permissive 1 0.5 permission is hereby granted free of charge
[apache]
apache-2.0 4 0.98 apache {l} {v}2(?: 0)?
apache-2.0 4 0.98 {by} apache {l} {v}2(?: 0)?
apache-2.0 4 0.95 apache software {l} {v}2(?: 0)?
apache-2.0 4 0.95 apache {v}2(?: 0)? {l}
apache-1.1 4 0.95 apache (?:software )?{l} {v}1 1
apache-1.0 4 0.95 apache (?:software )?{l} {v}1 0
apache 3 0.85 {by} apache {l}
apache 2 0.75 apache {l}
apache 2 0.7 apache software {l}
apache-2.0 2 0.8 apache 2 0
apache-2.0 3 0.95 http www apache org licenses license 2 0
apache-2.0 3 0.95 you may not use this file except in compliance with the {l} you may obtain a copy of the {l} at http(?:s)? www apache org
apache-2.0 4 0.9 apache lizenz {v}2(?: 0)?
apache-2.0 4 0.9 licence apache {v}2(?: 0)?
apache-2.0 4 0.9 licencia apache {v}2(?: 0)?
[compliance]
other-permissive 1 0.5 you may not use this file except in compliance with the {l}
[bsd freebsd]
bsd-2-clause 4 0.95 bsd 2 clause(?: {l})?
bsd-2-clause 4 0.95 2 clause bsd(?: {l})?
bsd-2-clause 4 0.95 two clause bsd(?: {l})?
bsd-2-clause 3 0.95 simplified bsd {l}
bsd-2-clause 3 0.9 freebsd {l}
bsd-3-clause 4 0.95 bsd 3 clause(?: {l})?
bsd-3-clause 4 0.95 3 clause bsd(?: {l})?
bsd-3-clause 4 0.95 three clause bsd(?: {l})?
bsd-3-clause 3 0.95 (?:new|revised|modified) bsd {l}
bsd-4-clause 4 0.95 (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: {l})?
bsd-4-clause 3 0.9 (?:original|old) bsd {l}
bsd-3-clause-clear 4 0.95 clear bsd {l}
0bsd 4 0.95 (?:zero clause|0 clause|free public) bsd {l}
bsd 3 0.85 {by} bsd {l}
bsd 2 0.8 bsd {l}
bsd 2 0.75 bsd style {l}
[0bsd]
0bsd 2 0.85 0bsd
[redistribution contributors advertising]
bsd 3 0.9 redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause 3 0.9 neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse
bsd-4-clause 3 0.9 all advertising materials mentioning features or use of this software must display
[gnu]
gpl-1.0 4 0.98 gnu general public {l} {v}1(?: 0)?
gpl-2.0 4 0.98 gnu general public {l} {v}2(?: 0)?
gpl-2.0-or-later 4 0.98 gnu general public {l} {v}2(?: 0)? or (?:any )?later
gpl-2.0-or-later 4 0.98 gnu general public {l} as published by the free software foundation either version 2
gpl-3.0 4 0.98 gnu general public {l} {v}3(?: 0)?
gpl-3.0-or-later 4 0.98 gnu general public {l} {v}3(?: 0)? or (?:any )?later
gpl-3.0-or-later 4 0.98 gnu general public {l} as published by the free software foundation either version 3
gpl 3 0.9 {by} gnu general public {l}
gpl 3 0.9 gnu general public {l}
lgpl-2.0 4 0.98 gnu library general public {l}(?: {v}2(?: 0)?)?
lgpl-2.1 4 0.98 gnu lesser general public {l} {v}2(?: 1)?
lgpl-2.1-or-later 4 0.98 gnu lesser general public {l} {v}2 1 or (?:any )?later
lgpl-3.0 4 0.98 gnu lesser general public {l} {v}3(?: 0)?
lgpl-3.0-or-later 4 0.98 gnu lesser general public {l} {v}3(?: 0)? or (?:any )?later
lgpl 3 0.9 gnu lesser general public {l}
agpl-3.0 4 0.98 gnu affero general public {l} {v}3(?: 0)?
agpl-3.0-or-later 4 0.98 gnu affero general public {l} {v}3(?: 0)? or (?:any )?later
agpl 3 0.9 gnu affero general public {l}
gfdl-1.1 4 0.98 gnu free documentation {l} {v}1 1
gfdl-1.2 4 0.98 gnu free documentation {l} {v}1 2
gfdl-1.3 4 0.98 gnu free documentation {l} {v}1 3
gfdl 3 0.9 gnu free documentation {l}
gnu-all-permissive 3 0.85 gnu all permissive {l}
gpl 2 0.75 gnu gpl
lgpl 2 0.75 gnu lgpl
agpl 2 0.75 gnu agpl
gfdl 2 0.75 gnu f?fdl
gpl 2 0.7 gnu public {l}
[gpl gpl1 gpl2 gpl3 gplv1 gplv2 gplv3 lgpl lgpl2 lgpl3 lgplv2 lgplv3 agpl agpl3 agplv3]
gpl-1.0 4 0.9 gpl ?{v}1(?: 0)?
gpl-2.0 4 0.95 gpl ?{v}2(?: 0)?
gpl-2.0-or-later 4 0.95 gpl ?{v}2(?: 0)? or later
gpl-3.0 4 0.95 gpl ?{v}3(?: 0)?
gpl-3.0-or-later 4 0.95 gpl ?{v}3(?: 0)? or later
lgpl-2.0 4 0.95 lgpl ?{v}2(?: 0)?
lgpl-2.1 4 0.95 lgpl ?{v}2 1
lgpl-2.1-or-later 4 0.95 lgpl ?{v}2 1 or later
lgpl-3.0 4 0.95 lgpl ?{v}3(?: 0)?
lgpl-3.0-or-later 4 0.95 lgpl ?{v}3(?: 0)? or later
agpl-3.0 4 0.95 agpl ?{v}3(?: 0)?
agpl-3.0-or-later 4 0.95 agpl ?{v}3(?: 0)? or later
gpl 3 0.85 {by} gpl
lgpl 3 0.85 {by} lgpl
agpl 3 0.85 {by} agpl
gpl 2 0.75 gpl {l}
lgpl 2 0.75 lgpl {l}
agpl 2 0.75 agpl {l}
gpl-compatible 2 0.4 gpl compatible
[foundation]
other-copyleft 1 0.5 as published by the free software foundation
[mozilla]
mpl-1.0 4 0.98 mozilla public {l} {v}1 0
mpl-1.1 4 0.98 mozilla public {l} {v}1 1
mpl-2.0 4 0.98 mozilla public {l} {v}2(?: 0)?
mpl 3 0.9 mozilla public {l}
mpl-2.0 3 0.95 this source code form is subject to the terms of the mozilla public {l}
[mpl mpl1 mpl2 mplv1 mplv2]
mpl-1.1 4 0.9 mpl ?{v}1 1
mpl-2.0 4 0.9 mpl ?{v}2(?: 0)?
mpl 2 0.7 mpl {l}
[eclipse]
epl-1.0 4 0.98 eclipse public {l} {v}1(?: 0)?
epl-2.0 4 0.98 eclipse public {l} {v}2(?: 0)?
epl 3 0.9 eclipse public {l}
edl-1.0 4 0.95 eclipse distribution {l}(?: {v}1(?: 0)?)?
[epl epl1 epl2 eplv1 eplv2]
epl-1.0 4 0.85 epl ?{v}1(?: 0)?
epl-2.0 4 0.85 epl ?{v}2(?: 0)?
[{l}]
cpl-1.0 4 0.95 (?:ibm )?common public {l}(?: {v}1(?: 0)?)?
cpal-1.0 4 0.95 common public attribution {l}(?: {v}1(?: 0)?)?
cddl-1.0 4 0.98 common development and distribution {l} {v}1 0
cddl-1.1 4 0.98 common development and distribution {l} {v}1 1
cddl 3 0.9 common development and distribution {l}
[cddl cddl1 cddlv1]
cddl-1.0 4 0.9 cddl ?{v}1 0
cddl-1.1 4 0.9 cddl ?{v}1 1
cddl 2 0.75 cddl
[creative]
cc0-1.0 4 0.98 creative commons (?:cc0|zero)(?: {v}1(?: 0)?)?(?: universal)?
cc-by-1.0 4 0.98 creative commons attribution {v}1 0
cc-by-2.0 4 0.98 creative commons attribution {v}2 0
cc-by-2.5 4 0.98 creative commons attribution {v}2 5
cc-by-3.0 4 0.98 creative commons attribution {v}3 0
cc-by-4.0 4 0.98 creative commons attribution {v}4 0
cc-by-sa-2.0 4 0.98 creative commons attribution share ?alike {v}2 0
cc-by-sa-2.5 4 0.98 creative commons attribution share ?alike {v}2 5
cc-by-sa-3.0 4 0.98 creative commons attribution share ?alike {v}3 0
cc-by-sa-4.0 4 0.98 creative commons attribution share ?alike {v}4 0
cc-by-nd-3.0 4 0.98 creative commons attribution no ?deriv(?:s|atives)? {v}3 0
cc-by-nd-4.0 4 0.98 creative commons attribution no ?deriv(?:s|atives)? {v}4 0
cc-by-nc-3.0 4 0.98 creative commons attribution non ?commercial {v}3 0
cc-by-nc-4.0 4 0.98 creative commons attribution non ?commercial {v}4 0
cc-by-nc-sa-3.0 4 0.98 creative commons attribution non ?commercial share ?alike {v}3 0
cc-by-nc-sa-4.0 4 0.98 creative commons attribution non ?commercial share ?alike {v}4 0
cc-by-nc-nd-3.0 4 0.98 creative commons attribution non ?commercial no ?deriv(?:s|atives)? {v}3 0
cc-by-nc-nd-4.0 4 0.98 creative commons attribution non ?commercial no ?deriv(?:s|atives)? {v}4 0
cc-by-nc-nd 3 0.9 creative commons attribution non ?commercial no ?deriv(?:s|atives)?
cc-by-nc-sa 3 0.9 creative commons attribution non ?commercial share ?alike
cc-by-nc 3 0.9 creative commons attribution non ?commercial
cc-by-nd 3 0.9 creative commons attribution no ?deriv(?:s|atives)?
cc-by-sa 3 0.9 creative commons attribution share ?alike
cc-by 3 0.85 creative commons attribution
cc-pdm 3 0.9 creative commons public domain mark
cc 2 0.7 creative commons {l}
cc 1 0.6 creative commons
[cc]
cc-by-1.0 4 0.95 cc by {v}1 0
cc-by-2.0 4 0.95 cc by {v}2 0
cc-by-2.5 4 0.95 cc by {v}2 5
cc-by-3.0 4 0.95 cc by {v}3 0
cc-by-4.0 4 0.95 cc by {v}4 0
cc-by-sa-2.0 4 0.95 cc by sa {v}2 0
cc-by-sa-2.5 4 0.95 cc by sa {v}2 5
cc-by-sa-3.0 4 0.95 cc by sa {v}3 0
cc-by-sa-4.0 4 0.95 cc by sa {v}4 0
cc-by-nd-3.0 4 0.95 cc by nd {v}3 0
cc-by-nd-4.0 4 0.95 cc by nd {v}4 0
cc-by-nc-2.0 4 0.95 cc by nc {v}2 0
cc-by-nc-3.0 4 0.95 cc by nc {v}3 0
cc-by-nc-4.0 4 0.95 cc by nc {v}4 0
cc-by-nc-sa-3.0 4 0.95 cc by nc sa {v}3 0
cc-by-nc-sa-4.0 4 0.95 cc by nc sa {v}4 0
cc-by-nc-nd-3.0 4 0.95 cc by nc nd {v}3 0
cc-by-nc-nd-4.0 4 0.95 cc by nc nd {v}4 0
cc-by-nc-nd 3 0.85 cc by nc nd
cc-by-nc-sa 3 0.85 cc by nc sa
cc-by-nc 2 0.85 cc by nc
cc-by-nd 3 0.85 cc by nd
cc-by-sa 3 0.85 cc by sa
cc-by 2 0.75 cc by
[creativecommons]
cc-by-4.0 4 0.95 creativecommons org licenses by 4 0
cc-by-sa-3.0 4 0.95 creativecommons org licenses by sa 3 0
cc-by-sa-4.0 4 0.95 creativecommons org licenses by sa 4 0
cc-by-nc-4.0 4 0.95 creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 4 0.95 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 4 0.95 creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 4 0.95 creativecommons org licenses by nd 4 0
cc0-1.0 4 0.95 creativecommons org publicdomain zero 1 0
cc-pdm 4 0.95 creativecommons org publicdomain mark 1 0
[cc0 cc0v1]
cc0-1.0 4 0.9 cc0 ?{v}1(?: 0)?(?: universal)?
cc0-1.0 2 0.8 cc0
[domain]
public-domain 3 0.85 (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 3 0.85 (?:is|are) in the public domain
public-domain 3 0.8 no copyright (?:[^ ]+ ){0,4}public domain
pddl-1.0 4 0.95 public domain dedication and {l}(?: {v}1 0)?
public-domain 1 0.5 public domain
[commons]
odbl-1.0 4 0.98 open data commons open database {l}(?: {v}1 0)?
odc-by-1.0 4 0.98 open data commons attribution {l}(?: {v}1 0)?
pddl-1.0 4 0.98 open data commons public domain dedication(?: and {l})?
[database]
odbl-1.0 3 0.9 open database {l}(?: {v}1 0)?
[odbl]
odbl-1.0 2 0.8 odbl(?: {v}1 0)?
[odc]
odc-by-1.0 2 0.85 odc by(?: {v}1 0)?
[government]
ogl-1.0 4 0.95 open government {l} {v}1(?: 0)?
ogl-2.0 4 0.95 open government {l} {v}2(?: 0)?
ogl-3.0 4 0.95 open government {l} {v}3(?: 0)?
ogl 3 0.85 open government {l}
[{l}]
cdla-permissive-1.0 4 0.95 community data {l} agreement permissive {v}1 0
cdla-permissive-2.0 4 0.95 community data {l} agreement permissive {v}2 0
cdla-sharing-1.0 4 0.95 community data {l} agreement sharing {v}1 0
[isc]
isc 3 0.9 {by} isc {l}
isc 2 0.85 isc {l}
[distribute]
isc 3 0.9 permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hpnd 3 0.85 permission to use copy modify and distribute this software and its documentation for any purpose
[zlib]
zlib 2 0.85 zlib {l}
zlib-libpng 3 0.9 zlib libpng {l}
[libpng]
libpng 2 0.8 libpng {l}
[boost]
bsl-1.0 4 0.95 boost software {l}(?: {v}1 0)?
[unlicense]
unlicense 3 0.9 the unlicense
unlicense 2 0.7 unlicense
[unencumbered]
unlicense 3 0.95 this is free and unencumbered software released into the public domain
[wtfpl]
wtfpl 2 0.85 wtfpl
[fuck]
wtfpl 3 0.95 do what the fuck you want to public {l}
[beerware]
beerware 2 0.8 beerware {l}
[beer]
beerware 3 0.85 the beer ware {l}
[artistic]
artistic-1.0 4 0.95 artistic {l} {v}1 0
artistic-2.0 4 0.95 artistic {l} {v}2 0
artistic 2 0.75 artistic {l}
[perl]
perl 3 0.8 same terms as perl(?: itself)?
[eupl]
eupl-1.1 4 0.9 eupl {v}1 1
eupl-1.2 4 0.9 eupl {v}1 2
eupl 2 0.75 eupl
[european]
eupl-1.1 4 0.95 european union public {l} {v}1 1
eupl-1.2 4 0.95 european union public {l} {v}1 2
eupl 3 0.9 european union public {l}
[cecill]
cecill-2.1 4 0.9 cecill {v}2 1
cecill-b 3 0.85 cecill b
cecill-c 3 0.85 cecill c
cecill 2 0.75 cecill
[python]
psf-2.0 4 0.95 python software foundation {l} {v}2
psf 3 0.9 python software foundation {l}
[php]
php-3.01 4 0.95 php {l} {v}3 0?1
php 2 0.8 php {l}
[ruby]
ruby 2 0.75 ruby {l}
[openssl]
openssl 2 0.8 openssl {l}
[sil]
ofl-1.0 4 0.95 sil open font {l} {v}1 0
ofl-1.1 4 0.95 sil open font {l} {v}1 1
ofl 3 0.9 sil open font {l}
[latex]
lppl-1.3c 4 0.95 latex project public {l} {v}1 3c
lppl 3 0.9 latex project public {l}
[lppl]
lppl 2 0.75 lppl
[academic]
afl-2.1 4 0.95 academic free {l} {v}2 1
afl-3.0 4 0.95 academic free {l} {v}3 0
afl 3 0.85 academic free {l}
[{l}]
osl-3.0 4 0.95 open software {l} {v}3 0
osl 3 0.85 open software {l}
[postgresql]
postgresql 2 0.85 postgresql {l}
[ncsa]
ncsa 3 0.9 (?:university of illinois )?ncsa (?:open source )?{l}
[w3c]
w3c 3 0.85 w3c (?:software (?:notice )?(?:and )?)?{l}
[microsoft]
ms-pl 4 0.95 microsoft public {l}
ms-rl 4 0.95 microsoft reciprocal {l}
[ms]
ms-pl 2 0.8 ms pl
[server]
sspl-1.0 4 0.95 server side public {l}(?: {v}1)?
[sspl]
sspl-1.0 2 0.8 sspl
[elastic]
elastic-2.0 4 0.95 elastic {l} {v}2(?: 0)?
elastic 2 0.8 elastic {l}
[business]
busl-1.1 4 0.95 business source {l} {v}1 1
busl 3 0.9 business source {l}
[polyform]
polyform-noncommercial-1.0.0 4 0.95 polyform non ?commercial {l}(?: {v}1 0(?: 0)?)?
polyform-small-business-1.0.0 4 0.95 polyform small business {l}(?: {v}1 0(?: 0)?)?
polyform 2 0.75 polyform
[clause]
commons-clause 3 0.85 commons clause(?: {l})?(?: condition)?
[openrail rail]
openrail-m 3 0.85 (?:creativeml |bigscience )?open ?rail m
openrail 2 0.75 openrail
[llama]
llama-2 4 0.9 llama 2 community {l}
llama-3 4 0.9 (?:meta )?llama 3(?: [0-9])? community {l}
[gemma]
gemma 3 0.85 gemma terms of use
[json]
json 2 0.75 json {l}
[evil]
json 3 0.95 the software shall be used for good not evil
[reserved]
proprietary 1 0.5 all rights reserved
proprietary 3 0.8 copyright (?:[^ ]+ ){1,8}all rights reserved
proprietary 3 0.85 proprietary and confidential (?:[^ ]+ ){0,6}all rights reserved
[vorbehalten]
proprietary 1 0.5 alle rechte vorbehalten
[reservados]
proprietary 1 0.5 todos los derechos reservados
[réservés]
proprietary 1 0.5 tous droits réservés
[proprietary]
proprietary 3 0.85 proprietary and confidential
proprietary 3 0.8 proprietary {l}
[unauthorized]
proprietary 3 0.85 unauthorized copying of this (?:file|work|document|text)
[commercial]
non-commercial 2 0.6 (?:for )?non commercial use only
[noncommercial]
non-commercial 2 0.6 (?:for )?noncommercial use only
[commercial]
non-commercial 2 0.6 no commercial use
[personal]
non-commercial 2 0.55 for personal use only
[copyleft]
other-copyleft 1 0.4 copyleft
[licensed licenced]
dual 2 0.6 dual licen[cs]ed
[licensed]
other-license 1 0.3 licensed under
[licenced]
other-license 1 0.3 licenced under
[released]
other-license 1 0.25 released under
[{l}]
other-license 1 0.3 unter der lizenz
other-license 1 0.3 sous licence
other-license 1 0.3 bajo licencia
other-license 1 0.3 bajo la licencia
"""


class Rule(NamedTuple):
    number: int
    keywords: tuple[str, ...]
    label: str
    priority: int
    weight: float
    regex: str


def _read(table: str) -> list[Rule]:
    rules, keywords = [], ()
    for line in table.strip("\n").split("\n"):
        if line.startswith("["):
            keywords = tuple(_LICENSE if line == "[{l}]" else line[1:-1].split())
            continue
        label, priority, weight, regex = line.split(" ", 3)
        for name, body in _MACROS.items():
            regex = regex.replace(name, body)
        rules.append(Rule(len(rules), keywords, label, int(priority), float(weight), f" (?:{regex})(?= )"))
    return rules


#: In the order in which equal claims are settled.
RULES = _read(_TABLE)
