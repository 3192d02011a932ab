"""Glyph names of a compact font (CFF) program."""

from __future__ import annotations

#: The standard strings of the CFF specification, in order of their ids.
#: The first 229 are the glyphs of the ISOAdobe set.
STRINGS = """.notdef space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period
slash zero one two three four five six seven eight nine colon semicolon less equal greater question at A B C D E F G H I J K L M N O P Q R S
T U V W X Y Z bracketleft backslash bracketright asciicircum underscore quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z
braceleft bar braceright asciitilde exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft
guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright
guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut
ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls onesuperior logicalnot mu trademark
Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior
copyright Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave
Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron aacute acircumflex
adieresis agrave aring atilde ccedilla eacute ecircumflex edieresis egrave iacute icircumflex idieresis igrave ntilde oacute ocircumflex
odieresis ograve otilde scaron uacute ucircumflex udieresis ugrave yacute ydieresis zcaron exclamsmall Hungarumlautsmall dollaroldstyle
dollarsuperior ampersandsmall Acutesmall parenleftsuperior parenrightsuperior twodotenleader onedotenleader zerooldstyle oneoldstyle
twooldstyle threeoldstyle fouroldstyle fiveoldstyle sixoldstyle sevenoldstyle eightoldstyle nineoldstyle commasuperior threequartersemdash
periodsuperior questionsmall asuperior bsuperior centsuperior dsuperior esuperior isuperior lsuperior msuperior nsuperior osuperior
rsuperior ssuperior tsuperior ff ffi ffl parenleftinferior parenrightinferior Circumflexsmall hyphensuperior Gravesmall Asmall Bsmall Csmall
Dsmall Esmall Fsmall Gsmall Hsmall Ismall Jsmall Ksmall Lsmall Msmall Nsmall Osmall Psmall Qsmall Rsmall Ssmall Tsmall Usmall Vsmall Wsmall
Xsmall Ysmall Zsmall colonmonetary onefitted rupiah Tildesmall exclamdownsmall centoldstyle Lslashsmall Scaronsmall Zcaronsmall
Dieresissmall Brevesmall Caronsmall Dotaccentsmall Macronsmall figuredash hypheninferior Ogoneksmall Ringsmall Cedillasmall
questiondownsmall oneeighth threeeighths fiveeighths seveneighths onethird twothirds zerosuperior foursuperior fivesuperior sixsuperior
sevensuperior eightsuperior ninesuperior zeroinferior oneinferior twoinferior threeinferior fourinferior fiveinferior sixinferior
seveninferior eightinferior nineinferior centinferior dollarinferior periodinferior commainferior Agravesmall Aacutesmall Acircumflexsmall
Atildesmall Adieresissmall Aringsmall AEsmall Ccedillasmall Egravesmall Eacutesmall Ecircumflexsmall Edieresissmall Igravesmall Iacutesmall
Icircumflexsmall Idieresissmall Ethsmall Ntildesmall Ogravesmall Oacutesmall Ocircumflexsmall Otildesmall Odieresissmall OEsmall Oslashsmall
Ugravesmall Uacutesmall Ucircumflexsmall Udieresissmall Yacutesmall Thornsmall Ydieresissmall 001.000 001.001 001.002 001.003 Black Bold
Book Light Medium Regular Roman Semibold""".split()

#: String ids of the two predefined expert charsets, as first-last.
EXPERT = "0-1 229-238 13-15 99-99 239-248 27-28 249-266 109-110 267-318 158-158 155-155 163-163 319-326 150-150 164-164 169-169 327-378"
EXPERT_SUBSET = "0-1 231-232 235-238 13-15 99-99 239-248 27-28 249-251 253-266 109-110 267-270 272-272 300-302 305-305 314-315 158-158 155-155 163-163 320-326 150-150 164-164 169-169 327-346"


def _ids(ranges: str) -> list[int]:
    return [k for r in ranges.split() for k in range(int(r.split("-")[0]), int(r.split("-")[1]) + 1)]


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    count = int.from_bytes(data[at : at + 2], "big")
    if not count:
        return [], at + 2
    size = data[at + 2]
    offsets = [int.from_bytes(data[at + 3 + k * size : at + 3 + (k + 1) * size], "big") for k in range(count + 1)]
    base = at + 2 + (count + 1) * size
    return [data[base + a : base + b] for a, b in zip(offsets, offsets[1:])], base + offsets[-1]


def operand(data: bytes, at: int) -> tuple[int, int]:
    """A number of a dictionary, and where the next byte is. Reals are rounded."""
    b = data[at]
    if 32 <= b <= 246:
        return b - 139, at + 1
    if 247 <= b <= 250:
        return (b - 247) * 256 + data[at + 1] + 108, at + 2
    if 251 <= b <= 254:
        return -(b - 251) * 256 - data[at + 1] - 108, at + 2
    if b == 28:
        return int.from_bytes(data[at + 1 : at + 3], "big", signed=True), at + 3
    if b == 29:
        return int.from_bytes(data[at + 1 : at + 5], "big", signed=True), at + 5
    if b == 30:
        text, at = "", at + 1
        while True:
            for nibble in (data[at] >> 4, data[at] & 15):
                if nibble == 15:
                    value = float(text or 0)
                    return int(value + 0.5 if value >= 0 else value - 0.5), at + 1
                text += "0123456789.EE -"[nibble] if nibble != 12 else "E-"
            at += 1
    return 0, at + 1


def top_dict(data: bytes) -> dict[int, list[int]]:
    out, numbers, at = {}, [], 0
    while at < len(data):
        if data[at] <= 21:
            key = data[at]
            at += 1
            if key == 12:
                key = 1200 + data[at]
                at += 1
            out[key], numbers = numbers, []
        else:
            value, at = operand(data, at)
            numbers.append(value)
    return out


def glyph_names(data: bytes) -> list[str] | None:
    """The name of every glyph by index; None if the program can't be read."""
    try:
        _, at = _index(data, data[2])
        tops, at = _index(data, at)
        strings, _ = _index(data, at)
        top = top_dict(tops[0])
        glyphs, _ = _index(data, top[17][0])
        charset = top.get(15, [0])[0]
        sids = [0]
        if charset > 2:
            kind, at = data[charset], charset + 1
            while len(sids) < len(glyphs):
                first = int.from_bytes(data[at : at + 2], "big")
                if at + 2 > len(data):
                    break
                size = (0, 1, 2)[kind]
                left = int.from_bytes(data[at + 2 : at + 2 + size], "big")
                sids += range(first, first + left + 1)
                at += 2 + size
        else:
            sids = (list(range(229)), _ids(EXPERT), _ids(EXPERT_SUBSET))[charset]

        def name(sid: int) -> str:
            if sid < len(STRINGS):
                return STRINGS[sid]
            return strings[sid - len(STRINGS)].decode("latin-1") if 0 <= sid - len(STRINGS) < len(strings) else ""

        return [name(s) for s in sids[: len(glyphs)]]
    except (IndexError, KeyError, ValueError):
        return None
