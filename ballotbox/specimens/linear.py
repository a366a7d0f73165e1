"""Linear codes: Code 128 (sets B and C), Code 39 (no check character) and EAN-13, drawn from the published tables and read back from runs."""

from __future__ import annotations

import numpy as np

#: Code 128's bar and space widths by code value; the last is the stop pattern.
CODE_128 = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132
221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313
231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111
314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141
114131 311141 411131 211412 211214 211232 2331112
""".split()
#: Code 128's codes that change the set or start and stop.
TO_C, TO_B, START_B, START_C, STOP = 99, 100, 104, 105, 106
#: Code 39's nine elements by character, n narrow and w wide, from a bar on.
CODE_39 = {
    "0": "nnnwwnwnn", "1": "wnnwnnnnw", "2": "nnwwnnnnw", "3": "wnwwnnnnn", "4": "nnnwwnnnw", "5": "wnnwwnnnn", "6": "nnwwwnnnn", "7": "nnnwnnwnw", "8": "wnnwnnwnn", "9": "nnwwnnwnn",
    "A": "wnnnnwnnw", "B": "nnwnnwnnw", "C": "wnwnnwnnn", "D": "nnnnwwnnw", "E": "wnnnwwnnn", "F": "nnwnwwnnn", "G": "nnnnnwwnw", "H": "wnnnnwwnn", "I": "nnwnnwwnn", "J": "nnnnwwwnn",
    "K": "wnnnnnnww", "L": "nnwnnnnww", "M": "wnwnnnnwn", "N": "nnnnwnnww", "O": "wnnnwnnwn", "P": "nnwnwnnwn", "Q": "nnnnnnwww", "R": "wnnnnnwwn", "S": "nnwnnnwwn", "T": "nnnnwnwwn",
    "U": "wwnnnnnnw", "V": "nwwnnnnnw", "W": "wwwnnnnnn", "X": "nwnnwnnnw", "Y": "wwnnwnnnn", "Z": "nwwnwnnnn",
    "-": "nwnnnnwnw", ".": "wwnnnnwnn", " ": "nwwnnnwnn", "$": "nwnwnwnnn", "/": "nwnwnnnwn", "+": "nwnnnwnwn", "%": "nnnwnwnwn", "*": "nwnnwnwnn",
}
#: EAN's modules of the ten digits (set L), and the sets of the left half by the first digit.
EAN_L = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
EAN_SETS = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
WIDE = 3

EAN_R = [x.translate(str.maketrans("01", "10")) for x in EAN_L]
EAN_G = [x[::-1] for x in EAN_R]
_BY_WIDTHS = {x: i for i, x in enumerate(CODE_128)}
_BY_ELEMENTS = {v: k for k, v in CODE_39.items()}


def check_digit(digits: str) -> str:
    return str(-sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10)


def _widths(runs: str) -> str:
    """Modules from widths, a bar first."""
    return "".join("10"[i % 2] * int(n) for i, n in enumerate(runs))


def code_128(text: str) -> str:
    """Modules as a string, 1 is a bar. Runs of four digits or more (an even number) go in set C, all else in set B."""
    if not text or any(not 32 <= ord(c) <= 126 for c in text):
        raise ValueError("Code 128 here holds printable ASCII")
    codes, at, in_c = [], 0, None
    while at < len(text):
        end = at
        while end < len(text) and text[end].isdigit():
            end += 1
        digits = (end - at) // 2 * 2
        if digits >= 4 or in_c and digits >= 2:
            if not in_c:
                codes.append(START_C if in_c is None else TO_C)
            codes += [int(text[k : k + 2]) for k in range(at, at + digits, 2)]
            at, in_c = at + digits, True
        else:
            if in_c is not False:
                codes.append(START_B if in_c is None else TO_B)
            codes.append(ord(text[at]) - 32)
            at, in_c = at + 1, False
    check = (codes[0] + sum(i * c for i, c in enumerate(codes))) % 103
    return "".join(_widths(CODE_128[c]) for c in [*codes, check, STOP])


def code_39(text: str) -> str:
    if not text or any(c not in CODE_39 or c == "*" for c in text):
        raise ValueError("Code 39 holds digits, capitals and - . space $ / + %")
    return "0".join(_widths(CODE_39[c].replace("n", "1").replace("w", str(WIDE))) for c in f"*{text}*")


def ean_13(digits: str) -> str:
    """Of 12 digits, or 13 with a right check digit."""
    if len(digits) not in (12, 13) or not digits.isdigit() or len(digits) == 13 and check_digit(digits[:12]) != digits[12]:
        raise ValueError("EAN-13 holds 12 digits and their check digit")
    digits = digits[:12] + check_digit(digits[:12])
    left = "".join((EAN_L if s == "L" else EAN_G)[int(d)] for d, s in zip(digits[1:7], EAN_SETS[int(digits[0])], strict=True))
    return "101" + left + "01010" + "".join(EAN_R[int(d)] for d in digits[7:]) + "101"


DRAW = {"code_128": code_128, "code_39": code_39, "ean_13": ean_13}


def image(text: str, symbology: str, module: int = 3, height: int = 120, quiet: int = 12) -> np.ndarray:
    """Grey pixels, dark bars on white, ``quiet`` modules of white around."""
    bars = np.array([c == "1" for c in DRAW[symbology](text)])
    row = np.where(np.repeat(np.pad(bars, quiet), module), 0, 255).astype(np.uint8)
    return np.pad(np.repeat(row[None], height, 0), ((quiet * module,) * 2, (0, 0)), constant_values=255)


def read_runs(runs: list[int]) -> tuple[str, str] | None:
    """(symbology, text) of bar and space widths in pixels, a bar first and last; None if they are no whole code with a right check."""
    for read in (_read_ean, _read_128, _read_39):
        for way in (runs, runs[::-1]):
            if (found := read(way)) is not None:
                return read.__name__.replace("_read_", "").replace("128", "code_128").replace("39", "code_39").replace("ean", "ean_13"), found
    return None


def _modules(runs: list[int], total: int) -> list[int]:
    unit = sum(runs) / total
    return [max(1, round(r / unit)) for r in runs]


def _read_ean(runs: list[int]) -> str | None:
    if len(runs) != 59:
        return None
    modules = _widths("".join(map(str, _modules(runs, 95))))
    if len(modules) != 95 or modules[:3] + modules[45:50] + modules[92:] != "10101010101":
        return None
    left = [modules[3 + 7 * i : 10 + 7 * i] for i in range(6)]
    right = [modules[50 + 7 * i : 57 + 7 * i] for i in range(6)]
    sets = "".join("L" if x in EAN_L else "G" if x in EAN_G else "?" for x in left)
    if sets not in EAN_SETS or any(x not in EAN_R for x in right):
        return None
    digits = str(EAN_SETS.index(sets)) + "".join(str((EAN_L if x in EAN_L else EAN_G).index(x)) for x in left) + "".join(str(EAN_R.index(x)) for x in right)
    return digits if check_digit(digits[:12]) == digits[12] else None


def _read_128(runs: list[int]) -> str | None:
    if len(runs) < 25 or len(runs) % 6 != 1:
        return None
    codes = []
    for i in range(0, len(runs) - 7, 6):
        code = _BY_WIDTHS.get("".join(map(str, _modules(runs[i : i + 6], 11))))
        if code is None:
            return None
        codes.append(code)
    if "".join(map(str, _modules(runs[-7:], 13))) != CODE_128[STOP] or codes[0] not in (START_B, START_C):
        return None
    *codes, check = codes
    if (codes[0] + sum(i * c for i, c in enumerate(codes))) % 103 != check:
        return None
    out, in_c = "", codes[0] == START_C
    for c in codes[1:]:
        if in_c and c < 100:
            out += f"{c:02d}"
        elif not in_c and c < 95:
            out += chr(c + 32)
        elif c == (TO_B if in_c else TO_C):
            in_c = not in_c
        else:
            return None
    return out


def _read_39(runs: list[int]) -> str | None:
    if len(runs) < 29 or len(runs) % 10 != 9:
        return None
    out, narrow = "", min(runs)
    for i in range(0, len(runs), 10):
        c = _BY_ELEMENTS.get("".join("w" if r > 1.8 * narrow else "n" for r in runs[i : i + 9]))
        if c is None:
            return None
        out += c
    return out[1:-1] if len(out) > 2 and out[0] == out[-1] == "*" and "*" not in out[1:-1] else None
