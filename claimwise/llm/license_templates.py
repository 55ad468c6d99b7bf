"""Licence families and the paragraphs that tell them, the
published wordings of notices and key sentences, shortened to what a scan needs."""

TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
             "the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, LGPL."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3, AGPL."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
            "without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "This work is in the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
    ("proprietary", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

# Ordinary sentences with the same words, for the unknown class.
ORDINARY = [
    "The driver lost the license after the accident.",
    "A permit is required and the license fee must be paid in advance.",
    "The version of the story that the general public knows is different.",
    "She was granted permission to work from home.",
    "The foundation published the terms of the prize in the spring.",
    "The software runs on a computer with a free port.",
    "Rights of workers were discussed in the meeting.",
    "He reserved all the seats in the first row.",
    "They released the record under the name of the band.",
    "The copyright dispute between the two publishers went on for years.",
    "The source of the river is in the mountains.",
    "The author has waived the fee for the lecture.",
]
