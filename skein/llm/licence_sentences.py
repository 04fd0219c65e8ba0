"""Known licence sentences: of each licence text the identities (licences.identity) of sentences that only it has,
in its order, at most 14 of a long text, spread over it; and the names of the SPDX licence list."""

TEXTS: dict[str, list[int]] = {
    "Apache-2.0": [
        0xc05aab35ca306bf5, 0x7280cfe2914cbb68, 0x527a55524e1a2494, 0xbf22a8c62b255172, 0x234593646e3711fa,
        0xc63ca1bae4e6da3d, 0x8e51c3bb9af8834b, 0x663efacbed0e7e55, 0x14e9f8b70ac2f48c, 0x83f68a4c1edf24f5,
        0xd3e87aeb27d0431b, 0x3fc361358da693e1, 0xd912ad47496fda48, 0xb7379ab2049e9e8,
    ],
    "Artistic-1.0": [
        0xd1ebe632d8e2f060, 0x38d7d7b6ddd2a5bd, 0x21571fb1c9b58a76, 0x3a0a6b5b2b75966b, 0xd118ec6c670acfdd,
        0x43b50db5e5eb30b, 0x6b7e2dae7246410f, 0x2236cf1804d025db, 0xba5e327369354a17, 0x8d787543953ba08c,
        0x4a8fe4f0d0a4138c, 0xad1386afd4eac4c4, 0x34bf9b393e330bc3, 0x3e800aab893b2bb3,
    ],
    "CC0-1.0": [
        0xbd3256863c5618c0, 0x32bd8b3c5d375ea4, 0x58ab94374ba5ba3c, 0xbbd213478acd42f6, 0xe46478f62332354b,
        0x8e3d881de015f797, 0xa9be4f392ad04850, 0xedacdee7ff7ed7cd, 0xaeeeebf240cdf5eb, 0xa220403f10167f6b,
        0x8d525124600fda9f, 0xf4fa673e4f3eefa8, 0x9a66c9700b2e90c9, 0x802fde324e2609ba,
    ],
    "GFDL-1.2": [
        0xcc964e251b69fe26, 0x28864c3fa8229d12, 0x118622ff5af3b9fc, 0xfb5e63461b2a36f3, 0x651b52ad3871a126,
        0xcff97909fe294d4, 0x173e5bb9a7d41ea8, 0xa108eb68b61d1b24, 0xe534f4fb203caedd,
    ],
    "GFDL-1.3": [
        0x8b2d766d16d33a44, 0x8550c2c2c279b824, 0xba47bbff55411a83, 0xc9838b24a5d65fde, 0xc21f6e92ae527ce9,
        0x51d184ad63b84cb5, 0x1b902d887611e8f4, 0x89954421bd53183d, 0x86f29a68c025ca6c, 0x673fc92c74926a83,
        0xd9001d55f03f47cc, 0xba6af52ae7548869, 0xa2d262c5992ef687, 0x8bfdafd261fa32d0,
    ],
    "GPL-1.0": [
        0x607b59dc6d4979e4, 0x5f93eea2387a24a4, 0xf5de03f13e815592, 0xd06adcbf923704ca, 0x7c6b4e1086bf321d,
        0x31022f45adc935a8, 0x3814177f8018ba37, 0xa0903b2f21f0b796, 0x393447ef0000f882, 0x2e857fe031caafbd,
        0x52defc1a10a200eb, 0x742eef60c6dceaba, 0xd3e7939586f12af8, 0x6d3d2a04f8dd68d5,
    ],
    "GPL-2.0": [
        0xa47cfeec4c54ccc1, 0xf256f8051a481cc7, 0xefbdb230b62c26c6, 0xc59e70a617c82d97, 0x357aa10efd7e521c,
        0xa68b3694d4e19bb5, 0x2409e1b076bf34da, 0x259623f7f0f3bb9e, 0x2cf736375565053b, 0xe3328a1547d7e0df,
        0x1fc9ec0ae5cb2764, 0xcdd3cfb96889b86c, 0xfc847136ab10e21b, 0x12c10b0e87a26b13,
    ],
    "GPL-3.0": [
        0x9755d59fa8f73771, 0x82c75981bf3c1a7, 0x2c670ffdb3b8afbf, 0x246684a5b98b5572, 0x28986e4c509d9b5b,
        0xaf937d999f16e8dc, 0xcb918e138ba1437f, 0x1a8d998d394e5396, 0x19b361ec65e9bf56, 0x10a516d9cd37affc,
        0xc6ff262dd93e800f, 0x58f833e707392a18, 0xed04f5f1f623d0ea, 0x18c1272bb7a33ac7,
    ],
    "LGPL-2.0": [
        0xb740360fea97534e, 0x3561878977213371, 0x27641b28c1fe249d, 0xd885d83f31f297b7, 0x35ba386cfdae49cb,
        0x25d461b9ec173875, 0xfbdbc8eb5253164e, 0x35f06427d7f8d15a, 0x1e7ce82d72390b0e, 0x99f10855e87dc772,
        0xa11fced936cd1739, 0xe960cc7eb9e2e01a, 0x1d7b9e9fb4106eba, 0x68eedb1708eb1b94,
    ],
    "LGPL-2.1": [
        0xb8afed269cb71fa0, 0x9d362c8cf5690133, 0xe8e74399bfeaca25, 0xf9d7b98beb5d796d, 0x703439aeb19ea04c,
        0x505e4e6278e111f4, 0xbb9b7ed981c21235, 0x5041824b7c8e7a61, 0x97276efe5f136e1, 0x103a85386cfedafe,
        0xec8adfe93e2efbd5, 0x5a65260cd584dbf7, 0x6c99f5e071ccf3ba, 0xc7b226cfa75e7c07,
    ],
    "LGPL-3.0": [
        0x3303292f27fcfdb6, 0x326c136bfa1c33a8, 0xf3fbfb337ade1fc7, 0xb6d9ba11fec7786f, 0xe4ec2696e052f910,
        0x69b688ec016ccb6b, 0xe16dfbe5b9c454b8, 0x8af520f483b7aa31, 0x462e091e5c184fb8, 0x2c15528b4c2e89c1,
        0x8cb376c75a56de87, 0xb5ebffc2b334c277, 0x4d3bac0c33cc52a9, 0x8580f5aa286ff556,
    ],
    "MPL-1.1": [
        0x146551058a532e49, 0xdb40a6863f24eef7, 0xe7a2590c79f6f35a, 0xb7633db29d57e5dc, 0xc80d8e3f5536f110,
        0x6fbb166b3ad93659, 0x880561aec91bea76, 0x5ed9ec8b332ad3f3, 0x43ed279e47eacf42, 0xc79b0661d179af68,
        0x5b4f6bb9e33e3d23, 0x7b4f1993b95fe501, 0x6d607683d6a70d59, 0x492f6178ea9b58a6,
    ],
    "MPL-2.0": [
        0x2063a3eaee989071, 0x639c0598cdeeefc, 0xb72a5437a3a159b3, 0xdb5c6408f6d732fa, 0xb5e78df333e20f6f,
        0x83bb98443860cab1, 0xf903a7833ef38d43, 0xde42a7d4c1fb00ae, 0xf9ff946232a664a2, 0xd9ddc1311638d4c,
        0x7cf5c5157ed30d2a, 0x9f4fddefacf4b18d, 0x427046353859fb01, 0x48ab5bc3f42b610d,
    ],
    "Zlib": [
        0x9568aac3795b5193, 0x34ea79807501ef4c, 0xb663b3ea6f66c134,
    ],
    "BSL-1.0": [
        0x5b68e0902eeca213, 0xd235d761ef19bd9a, 0xe7603f55d33bf29,
    ],
    "ISC": [
        0x9502a26842dfdaf3, 0xb1d9d8c3d08825f8, 0x1f0ffb6cd5d59e10, 0xbc4adf20b11e95f,
    ],
    "Unicode-DFS-2016": [
        0x66fef6d5f775b18, 0x58333a0110773304, 0x9813c0bd46f99072, 0xf0eaad30dfcf38d5, 0x70fc65e127880a41,
        0xfad7ff46e32ab8f7, 0xd1e5a49541f1d703,
    ],
    "Unicode-3.0": [
        0xcdb2cc26fea96b1e, 0x5c1cb419c6c1908b, 0xad58fdb69ae0b7e2, 0x8f34da448f5b6f6, 0x46e22de5675b1c6,
        0x1199eb901a62990c, 0x91d8950ea696f74,
    ],
    "Python-2.0": [
        0xb6d2661eebe88f70, 0x133ad483c1b3885f, 0xe759fa35b43cdf98, 0x880b8b2ed7ecc46b, 0x1cf4f5d69d9918ae,
        0xb4cf6a332f30a5fb, 0x914772f7e922ac8f, 0xce96945f8994fe8, 0xb128c68a3ce24f69, 0x1f9454ccb208d596,
        0x4b33c305733cd28f, 0x791b12fece0a615c, 0x48606f52b3f529d8, 0xd1679b289465c5c1,
    ],
    "Unlicense": [
        0xf48b6225eea2be7, 0xaab71ddfd1c8806c, 0xdc73c5dacde5d62b, 0xf42bf63d5b4bbf17, 0xe1c0d075b282441,
        0x909c1e407d62a27a,
    ],
    "WTFPL": [
        0x42709b7889105722,
    ],
    "Artistic-2.0": [
        0x5e6fd4897c043ef5, 0xa88e8d2c3033e5aa, 0xaa3ad4ecf0047bf9, 0x199b688d896b6f3a, 0x5fd4eff26c8c9484,
        0xb82aecec84275e01, 0x753a3464cf3425d7, 0x24fe89ec3f40ed33, 0xeae49ebb221ee9f8, 0x818f9d8174ffe33b,
        0xda172df974872034, 0x80bc7e07f5bcb609, 0xdd65913d1a46c72f, 0x50fb4c3f9ba2bb05,
    ],
    "BlueOak-1.0.0": [
        0x88061f1386c1ba38, 0x688f6c863ccd498a, 0x238addc7215b3026, 0x458898fda92d29a7, 0xf1941a2f00d7b865,
        0x5ba6caa2d16a20a8, 0x935ee2f4e0c961d0, 0xa6f2afad18ce484f,
    ],
    "TCL": [
        0x1f9e5e96047f5225, 0x5aefdf74ff412a1e, 0x6c67afdc86d220f0, 0x8a619e24498624a9, 0xc8980b83ca452ee1,
        0xe6996f83f5dece92, 0x91446d12ef19f425, 0x23108d9cc09f6bad, 0xa41ac1278f8842b6, 0xe7913b3bfe52a388,
        0xba64a9b4f5d560c5, 0x82e46323f937597a,
    ],
    "curl": [
        0x3acbfb5faf569676, 0xf8fef5fd45871a11, 0x6fbd736689bcb490,
    ],
    "BSD-3-Clause": [
        0xbed7760d8e524f47, 0x83ff0874e4a770da, 0x988c29bbf7ff7722,
    ],
    "BSD-2-Clause": [
        0x499b7b8ccb0b3b7c, 0x49f545630fd42f3b, 0x99be601211c414f5, 0x16b87f5fd905d0f6,
    ],
    "MIT": [
        0x12728acb0b5a0459, 0x90a4aad1f7ce2c43, 0xeb3757f70c615e2f, 0xa56cc62abbb5efdc, 0xbbbe15f51feff0aa,
    ],
    "bzip2-1.0.6": [
        0xb8f57e81b8af00bc, 0x997103c2b4a83441, 0x19e89501efc22cf8, 0x2da80735a28365f0, 0x492bf4382ab6f0e0,
        0x2ed307a894233508,
    ],
    "X11": [
        0xbb5bfffe08e44ccf, 0xa64db2d0bbe450f7, 0x7630c66234060b98, 0x85b79b8e182434e0,
    ],
    "0BSD": [
        0x220170a6c0b5887a, 0xca03c51446dd717e, 0xdd9d3949fbe9d23,
    ],
    "MIT-0": [
        0xbea0eeeb407805a7,
    ],
    "PostgreSQL": [
        0xda10047fb6138695,
    ],
    "NCSA": [
        0xdac7d5e8d9458c0, 0x738853da9825db6d,
    ],
    "FSFAP": [
        0x867120c08e95674,
    ],
    "FSFUL": [
        0xc6494bbfc59f6da0,
    ],
}

IDS: dict[str, str] = {name.lower(): name for name in """
0BSD 3D-Slicer-1.0 AAL ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later
ALGLIB-Documentation AMD-newlib AMDPLPA AML AML-glslang AMPAS ANTLR-PD ANTLR-PD-fallback APAFML APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 ASWF-
Digital-Assets-1.0 ASWF-Digital-Assets-1.1 Abstyles AdaCore-doc Adobe-2006 Adobe-Display-PostScript Adobe-Glyph Adobe-Utopia Advanced-Cryptics-
Dictionary Afmparse Aladdin Apache-1.0 Apache-1.1 Apache-2.0 App-s2p Arphic-1999 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0
Artistic-dist Aspell-RU BOLA-1.1 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Darwin BSD-2-Clause-FreeBSD BSD-2-Clause-NetBSD BSD-2-Clause-Patent
BSD-2-Clause-Views BSD-2-Clause-first-lines BSD-2-Clause-pkgconf-disclaimer BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-HP
BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Military-License BSD-3-Clause-No-Nuclear-License BSD-3-Clause-No-Nuclear-License-2014
BSD-3-Clause-No-Nuclear-Warranty BSD-3-Clause-Open-MPI BSD-3-Clause-Sun BSD-3-Clause-Tso BSD-3-Clause-acpica BSD-3-Clause-flex BSD-4-Clause
BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-4.3RENO BSD-4.3TAHOE BSD-Advertising-Acknowledgement BSD-Attribution-HPND-disclaimer BSD-Inferno-Nettverk
BSD-Mark-Modifications BSD-Protection BSD-Source-Code BSD-Source-beginning-file BSD-Systemics BSD-Systemics-W3Works BSL-1.0 BUSL-1.1 Baekmuk Bahyph
Barr Beerware BitTorrent-1.0 BitTorrent-1.1 Bitstream-Charter Bitstream-Vera BlueOak-1.0.0 Boehm-GC Boehm-GC-without-fee Borceux Brian-
Gladman-2-Clause Brian-Gladman-3-Clause Buddy C-UDA-1.0 CAL-1.0 CAL-1.0-Combined-Work-Exception CAPEC-tou CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-
BY-2.5-AU CC-BY-3.0 CC-BY-3.0-AT CC-BY-3.0-AU CC-BY-3.0-DE CC-BY-3.0-IGO CC-BY-3.0-NL CC-BY-3.0-US CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5
CC-BY-NC-3.0 CC-BY-NC-3.0-DE CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-3.0-DE CC-BY-NC-ND-3.0-IGO CC-
BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.0-DE CC-BY-NC-SA-2.0-FR CC-BY-NC-SA-2.0-UK CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-
SA-3.0-DE CC-BY-NC-SA-3.0-IGO CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-3.0-DE CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-
SA-2.0 CC-BY-SA-2.0-UK CC-BY-SA-2.1-JP CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-3.0-AT CC-BY-SA-3.0-DE CC-BY-SA-3.0-IGO CC-BY-SA-4.0 CC-PDDC CC-PDM-1.0 CC-
SA-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDL-1.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B
CECILL-C CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CFITSIO CMU-Mach CMU-Mach-nodoc CNRI-Jython CNRI-Python CNRI-Python-
GPL-Compatible COIL-1.0 CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 Caldera Caldera-no-preamble Catharon ClArtistic Clips Community-Spec-1.0 Condor-1.1
Cornell-Lossless-JPEG Cronyx Crossword CryptoSwift CrystalStacker Cube D-FSL-1.0 DEC-3-Clause DL-DE-BY-2.0 DL-DE-ZERO-2.0 DOC DRL-1.0 DRL-1.1 DSDP
DocBook-DTD DocBook-Schema DocBook-Stylesheet DocBook-XML Dotseqn ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 EPICS EPL-1.0 EPL-2.0 ESA-PL-permissive-2.4 ESA-PL-
strong-copyleft-2.4 ESA-PL-weak-copyleft-2.4 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa ErlPL-1.1 Eurosym FBM FDK-AAC FSFAP FSFAP-no-
warranty-disclaimer FSFUL FSFULLR FSFULLRSD FSFULLRWD FSL-1.1-ALv2 FSL-1.1-MIT FTL Fair Ferguson-Twofish Frameworx-1.0 FreeBSD-DOC FreeImage Furuseth
GCR-docs GD GFDL-1.1 GFDL-1.1-invariants-only GFDL-1.1-invariants-or-later GFDL-1.1-no-invariants-only GFDL-1.1-no-invariants-or-later GFDL-1.1-only
GFDL-1.1-or-later GFDL-1.2 GFDL-1.2-invariants-only GFDL-1.2-invariants-or-later GFDL-1.2-no-invariants-only GFDL-1.2-no-invariants-or-later
GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-invariants-only GFDL-1.3-invariants-or-later GFDL-1.3-no-invariants-only GFDL-1.3-no-invariants-or-
later GFDL-1.3-only GFDL-1.3-or-later GL2PS GLWTPL GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0-with-GCC-
exception GPL-2.0-with-autoconf-exception GPL-2.0-with-bison-exception GPL-2.0-with-classpath-exception GPL-2.0-with-font-exception GPL-3.0
GPL-3.0-only GPL-3.0-or-later GPL-3.0-with-GCC-exception GPL-3.0-with-autoconf-exception Game-Programming-Gems Giftware Glide Glulxe Graphics-Gems
Gutmann HDF5 HIDAPI HP-1986 HP-1989 HPND HPND-DEC HPND-Fenneberg-Livingston HPND-INRIA-IMAG HPND-Intel HPND-Kevlin-Henney HPND-MIT-disclaimer HPND-
Markus-Kuhn HPND-Netrek HPND-Pbmplus HPND-SMC HPND-UC HPND-UC-export-US HPND-doc HPND-doc-sell HPND-export-US HPND-export-US-acknowledgement HPND-
export-US-modify HPND-export2-US HPND-merchantability-variant HPND-sell-MIT-disclaimer-xserver HPND-sell-regexpr HPND-sell-variant HPND-sell-variant-
MIT-disclaimer HPND-sell-variant-MIT-disclaimer-rev HPND-sell-variant-critical-systems HTMLTIDY HaskellReport Hippocratic-2.1 IBM-pibs ICU IEC-Code-
Components-EULA IJG IJG-short IPA IPL-1.0 ISC ISC-Veillard ISO-permission ImageMagick Imlib2 Info-ZIP Inner-Net-2.0 InnoSetup Intel Intel-ACPI
Interbase-1.0 JPL-image JPNIC JSON Jam JasPer-2.0 Kastrup Kazlib Knuth-CTAN LAL-1.2 LAL-1.3 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LGPLLR LOOP LPD-document LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2
LPPL-1.3a LPPL-1.3c LZMA-SDK-9.11-to-9.20 LZMA-SDK-9.22 Latex2e Latex2e-translated-notice Leptonica LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Libpng
Linux-OpenIB Linux-man-pages-1-para Linux-man-pages-copyleft Linux-man-pages-copyleft-2-para Linux-man-pages-copyleft-var Lucida-Bitmap-Fonts MIPS MIT
MIT-0 MIT-CMU MIT-Click MIT-Festival MIT-Khronos-old MIT-Modern-Variant MIT-STK MIT-Wu MIT-advertising MIT-enna MIT-feh MIT-open-group MIT-testregex
MITNFA MMIXware MMPL-1.0.1 MPEG-SSG MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-LPL MS-PL MS-RL MTLL Mackerras-3-Clause
Mackerras-3-Clause-acknowledgment MakeIndex Martin-Birgmeier McPhee-slideshow Minpack MirOS Motosoto MulanPSL-1.0 MulanPSL-2.0 Multics Mup NAIST-2003
NASA-1.3 NBPL-1.0 NCBI-PD NCGL-UK-2.0 NCL NCSA NGPL NICTA-1.0 NIST-PD NIST-PD-TNT NIST-PD-fallback NIST-Software NLOD-1.0 NLOD-2.0 NLPL NOSL NPL-1.0
NPL-1.1 NPOSL-3.0 NRL NTIA-PD NTP NTP-0 Naumen Net-SNMP NetCDF Newsletr Nokia Noweb Nunit O-UDA-1.0 OAR OCCT-PL OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFFIS
OFL-1.0 OFL-1.0-RFN OFL-1.0-no-RFN OFL-1.1 OFL-1.1-RFN OFL-1.1-no-RFN OGC-1.0 OGDL-Taiwan-1.0 OGL-Canada-2.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL
OLDAP-1.1 OLDAP-1.2 OLDAP-1.3 OLDAP-1.4 OLDAP-2.0 OLDAP-2.0.1 OLDAP-2.1 OLDAP-2.2 OLDAP-2.2.1 OLDAP-2.2.2 OLDAP-2.3 OLDAP-2.4 OLDAP-2.5 OLDAP-2.6
OLDAP-2.7 OLDAP-2.8 OLFL-1.3 OML OPL-1.0 OPL-UK-3.0 OPUBL-1.0 OSC-1.0 OSET-PL-2.1 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 OSSP OpenMDW-1.0 OpenPBS-2.3
OpenSSL OpenSSL-standalone OpenVision PADL PDDL-1.0 PHP-3.0 PHP-3.01 PPL PSF-2.0 ParaType-Free-Font-1.3 Parity-6.0.0 Parity-7.0.0 Pixar Plexus
PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 PostgreSQL Python-2.0 Python-2.0.1 QPL-1.0 QPL-1.0-INRIA-2004 Qhull RHeCos-1.1 RPL-1.1
RPL-1.5 RPSL-1.0 RSA-MD RSCPL Rdisc Ruby Ruby-pty SAX-PD SAX-PD-2.0 SCEA SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SGI-OpenGL SGMLUG-PM SGP4 SHL-0.5 SHL-0.51
SISSL SISSL-1.2 SL SMAIL-GPL SMLNJ SMPPL SNIA SOFA SPL-1.0 SSH-OpenSSH SSH-short SSLeay-standalone SSPL-1.0 SUL-1.0 SWL Saxpath SchemeReport Sendmail
Sendmail-8.23 Sendmail-Open-Source-1.1 SimPL-2.0 Sleepycat Soundex Spencer-86 Spencer-94 Spencer-99 StandardML-NJ SugarCRM-1.1.3 Sun-PPP Sun-PPP-2000
SunPro Symlinks TAPR-OHL-1.0 TCL TCP-wrappers TGPPL-1.0 TMate TORQUE-1.1 TOSL TPDL TPL-1.0 TTWL TTYP0 TU-Berlin-1.0 TU-Berlin-2.0 TekHVC TermReadKey
ThirdEye TrustedQSL UCAR UCL-1.0 UMich-Merit UPL-1.0 URT-RLE Ubuntu-font-1.0 UnRAR Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-TOU UnixCrypt
Unlicense Unlicense-libtelnet Unlicense-libwhirlpool VOSTROM VSL-1.0 Vim Vixie-Cron W3C W3C-19980720 W3C-20150513 WTFNMFPL WTFPL Watcom-1.0 Widget-
Workshop WordNet Wsuipa X11 X11-distribute-modifications-variant X11-no-permit-persons X11-swapped XFree86-1.1 XSkat Xdebug-1.03 Xerox Xfig Xnet
YPL-1.0 YPL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed Zeeff Zend-2.0 Zimbra-1.3 Zimbra-1.4 Zlib any-OSI any-OSI-perl-modules bcrypt-Solar-Designer blessing
bzip2-1.0.5 bzip2-1.0.6 check-cvs checkmk copyleft-next-0.3.0 copyleft-next-0.3.1 curl cve-tou diffmark dtoa dvipdfm eCos-2.0 eGenix etalab-2.0 fwlw
gSOAP-1.3b generic-xts gnuplot gtkbook hdparm hyphen-bulgarian iMatix jove libpng-1.6.35 libpng-2.0 libselinux-1.0 libtiff libutil-David-Nugent lsof
magaz mailprio man2html metamail mpi-permissive mpich2 mplus ngrep pkgconf pnmstitch psfrag psutils python-ldap radvd snprintf softSurfer ssh-keyscan
swrule threeparttable ulem w3m wwl wxWindows xinetd xkeyboard-config-Zinoviev xlock xpp xzoom zlib-acknowledgement
""".split()}
