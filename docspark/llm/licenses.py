"""Public licence texts and notices, as fixed values: SPDX id -> texts that stand for it whole, and digests of long texts.

Copyright lines are left out, as the scan leaves them out of what it compares."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZERO_BSD_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

KNOWN: dict[str, list[str]] = {
    "MIT": [MIT, "MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT, "Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
    "ISC": [f"{ISC_GRANT}\n\n{ISC_DISCLAIMER}", f"ISC License\n\n{ISC_GRANT}\n\n{ISC_DISCLAIMER}", "Released under the ISC License.", "Licensed under the ISC License."],
    "0BSD": [f"{ZERO_BSD_GRANT}\n\n{ISC_DISCLAIMER}", f"BSD Zero Clause License\n\n{ZERO_BSD_GRANT}\n\n{ISC_DISCLAIMER}"],
    "BSD-2-Clause": [f"{BSD_GRANT}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_DISCLAIMER}", f"BSD 2-Clause License\n\n{BSD_GRANT}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_DISCLAIMER}"],
    "BSD-3-Clause": [f"{BSD_GRANT}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_3}\n\n{BSD_DISCLAIMER}", f"BSD 3-Clause License\n\n{BSD_GRANT}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_3}\n\n{BSD_DISCLAIMER}", "Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "Zlib": [ZLIB, "zlib License\n\n" + ZLIB],
    "Apache-2.0": [APACHE_NOTICE, "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "GPL-3.0-or-later": [GPL3_NOTICE],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "MPL-2.0": [MPL_NOTICE],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: (license, digest of the canonical form, its length, its first word) of long texts as Debian has them in common-licenses: whole, and to the end of the terms.
WHOLE: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "034ae5390f583decb6035b4efecdc60a52d03c7ffa36048800e808bc85ad8593", 8751, "apache"),
    ("Apache-2.0", "4569de668b624d1865dbbc461f0267a9b0497cda055124d969773fea977535f4", 8723, "apache"),
    ("Apache-2.0", "f7ac0e2cd8ed263cfdfaab47b7e9f06c851447f95b80485a8dc7625a1ad331c5", 9768, "apache"),
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915", 5653, "the"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", 6691, "creative"),
    ("GFDL-1.2", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86", 19515, "gnu"),
    ("GFDL-1.3", "6b9794ec33b354e192c8493abb967e647116caaf4c728223f31cee4aa0e40928", 21883, "gnu"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415, "gnu"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", 9387, "gnu"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", 11702, "gnu"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017", 14391, "gnu"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", 17053, "gnu"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", 14419, "gnu"),
    ("GPL-3.0", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30", 33207, "gnu"),
    ("GPL-3.0", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee", 30738, "gnu"),
    ("GPL-3.0", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975", 30766, "gnu"),
    ("LGPL-2.0", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d", 23936, "gnu"),
    ("LGPL-2.0", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513", 22146, "gnu"),
    ("LGPL-2.0", "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a", 22118, "gnu"),
    ("LGPL-2.1", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e", 25023, "gnu"),
    ("LGPL-2.1", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a", 23206, "gnu"),
    ("LGPL-2.1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1", 23234, "gnu"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, "gnu"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986", 22448, "mozilla"),
    ("MPL-2.0", "4544af666fc42fe3ea03e86d5db9fef4f4c41c50c15f04550119fdb67822747b", 14354, "mozilla"),
]
