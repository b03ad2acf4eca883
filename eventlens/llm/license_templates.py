"""Public license texts and notices as template markup (see ``license_scan``).

Fixed values: the wording is that of the published licenses. ``[[...]]`` may be
left out, ``{{a|b}}`` is one of its alternatives, ``{{m-n}}`` is replaceable by
any m to n words. Case and whatever is not a word do not count."""

TEMPLATES: list[tuple[str, str]] = [
    ("mit", """[[The MIT License [[(MIT)]]]] [[Copyright [[{{(c)|©}}]] {{0-16}}]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be
        included in all copies or substantial portions of the Software."""),
    ("mit", "{{released|licensed|distributed|available}} under the [[terms of the]] MIT license"),
    ("isc", """Permission to use, copy, modify, and{{|/or}} distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: [[{{1|a}}.]] Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. [[{{2|b}}.]] Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: [[{{1|a}}.]] Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. [[{{2|b}}.]] Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. [[{{3|c}}.]] Neither the name{{|s}} of
        {{1-12}} may be used to endorse or promote products derived from this software without specific prior written
        permission."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        {{1-6}} be held liable for any damages arising from the use of this software. Permission is granted to anyone
        to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions"""),
    ("apache-2.0", "licensed under the Apache License [[,]] Version 2{{.0|}}"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at [[{{1-12}}]] Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS"""),
    ("gpl-2.0", """{{license|licensed|released}} under the [[terms of the]] GNU General Public License [[as published
        by the Free Software Foundation]] {{version|v}} 2"""),
    ("gpl-3.0", """{{license|licensed|released}} under the [[terms of the]] GNU General Public License [[as published
        by the Free Software Foundation]] {{version|v}} 3"""),
    ("gpl-2.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version."""),
    ("gpl-3.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version."""),
    ("lgpl", """under the terms of the GNU {{Lesser|Library}} General Public License [[as published by the Free
        Software Foundation]]"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at"""),
    ("cc-by-4.0", """licensed under [[{{a|the}}]] {{CC|Creative Commons}} {{BY|Attribution}} 4.0"""),
    ("cc-by-nc-4.0", """licensed under [[{{a|the}}]] {{CC|Creative Commons}} {{BY-NC|Attribution-NonCommercial}} 4.0"""),
    ("cc-by-sa-4.0", """licensed under [[the]] {{CC|Creative Commons}} {{BY-SA|Attribution-ShareAlike}} 4.0"""),
    ("cc0-1.0", "{{CC0 1.0|Creative Commons Zero v1.0|CC0 1.0 Universal}} [[Public Domain Dedication]]"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
]
