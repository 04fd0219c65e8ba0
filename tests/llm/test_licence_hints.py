"""Known sentences that are wrapped, stand alone or are repeated."""

import pytest

from skein.llm import licences


@pytest.mark.parametrize(
    "text, want",
    [
        ("hereby placed in the public\ndomain by its author", ["LicenseRef-public-domain"]),
        ("/* All rights\n * reserved. */", ["LicenseRef-all-rights-reserved"]),
        ("Dedicated under creative\n# commons zero by us", ["CC0-1.0"]),
        ("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: Apache-2.0", ["MIT", "Apache-2.0"]),
    ],
)
def test_licences_of_wrapped_and_repeated_sentences(text, want):
    assert licences.scan(text)[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("In no event shall the authors be liable for any claim, damages or more.", "NoLiability"),
        ("Neither the name of the firm may be used to endorse or promote products.", "BSDEndorse"),
        ("All advertising materials mentioning features or use of this software must display thanks.", "BSDAdvert"),
        ("This software is provided by the regents as\n * is.", "BSDAsIs"),
    ],
)
def test_no_known_sentence_is_hidden(text, want):
    assert want in licences.scan(text)[1]
