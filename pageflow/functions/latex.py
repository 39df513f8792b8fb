"""LaTeX fragments as plain text: a small tokenizer and one fold over its tokens."""

from __future__ import annotations

import re

# Commands and the characters that they stand for, by sort.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η",
    "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ",
    "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ",
    "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ",
    "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
RELATIONS = {
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "sim": "∼",
    "simeq": "≃", "equiv": "≡", "propto": "∝", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "supset": "⊃",
    "supseteq": "⊇", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "leftrightarrow": "↔",
}
OPERATORS = {
    "times": "×", "cdot": "·", "pm": "±", "mp": "∓", "div": "÷", "infty": "∞", "partial": "∂", "nabla": "∇",
    "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "neg": "¬", "land": "∧", "lor": "∨", "sum": "∑",
    "prod": "∏", "int": "∫", "oint": "∮", "ldots": "…", "cdots": "⋯", "dots": "…", "prime": "′", "circ": "∘",
    "degree": "°",
}
SYMBOLS = GREEK | RELATIONS | OPERATORS
SUPERSCRIPTS = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", strict=True))
SUBSCRIPTS = dict(zip("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", strict=True))
TEXT_COMMANDS = frozenset("text textbf textit textrm textsf texttt emph mathrm mathbf mathit mathsf mathcal mathbb operatorname mbox hbox boldsymbol underline overline".split())
SPACES = {"\\,": " ", "\\;": " ", "\\:": " ", "\\!": "", "\\ ": " ", "\\quad": " ", "\\qquad": "  ", "~": " "}
VULGAR = {(1, 4): "¼", (1, 2): "½", (3, 4): "¾", (1, 7): "⅐", (1, 9): "⅑", (1, 10): "⅒", (1, 3): "⅓", (2, 3): "⅔", (1, 5): "⅕", (2, 5): "⅖", (3, 5): "⅗", (4, 5): "⅘", (1, 6): "⅙", (5, 6): "⅚", (1, 8): "⅛", (3, 8): "⅜", (5, 8): "⅝", (7, 8): "⅞"}
MAX_DEPTH = 24
_TOKEN = re.compile(r"\\[A-Za-z]+\*?|\\.|[{}^_~]|[^\\{}^_~]+", re.S)


def scripts(value: str, table: dict[str, str]) -> str | None:
    """A text in super- or subscript characters; None unless every character but blanks has one."""
    out = []
    for c in value:
        if c.isspace():
            out.append(c)
        elif c in table:
            out.append(table[c])
        else:
            return None
    return "".join(out)


def fraction(top: str, bottom: str) -> str:
    """A numeric fraction as one character where there is one, simple parts with a stroke, others in brackets."""
    if top.isdigit() and bottom.isdigit():
        return VULGAR.get((int(top), int(bottom)), f"{top}/{bottom}")
    wrap = lambda s: s if re.fullmatch(r"[\w.]+", s) else f"({s})"
    return f"{wrap(top)}/{wrap(bottom)}"


class _Reader:
    """Reads tokens and builds text; groups are read to their end, a missing end closes at the end of the text."""

    def __init__(self, text: str):
        self.tokens = _TOKEN.findall(text)
        self.at = 0

    def argument(self, depth: int) -> str:
        while self.at < len(self.tokens) and not self.tokens[self.at].strip():
            self.at += 1
        if self.at >= len(self.tokens):
            return ""
        token = self.tokens[self.at]
        if token == "{":
            self.at += 1
            return self.run(depth + 1)
        self.at += 1
        if token.startswith("\\"):
            self.at -= 1
            return self.step(depth + 1)
        rest = token.lstrip()
        if len(rest) > 1:
            self.at -= 1
            self.tokens[self.at] = rest[1:]
        return rest[:1]

    def step(self, depth: int) -> str:
        token = self.tokens[self.at]
        self.at += 1
        if token == "{":
            return self.run(depth + 1) if depth < MAX_DEPTH else ""
        if token in "^_":
            body = self.argument(depth)
            done = scripts(body, SUPERSCRIPTS if token == "^" else SUBSCRIPTS)
            return done if done is not None else token + (body if len(body) == 1 else f"({body})")
        if token in SPACES:
            return SPACES[token]
        if not token.startswith("\\"):
            return token
        name = token[1:].rstrip("*")
        if name in ("frac", "dfrac", "tfrac"):
            top = self.argument(depth)
            return fraction(top.strip(), self.argument(depth).strip())
        if name == "sqrt":
            body = self.argument(depth)
            return f"√{body}" if re.fullmatch(r"\w", body) else f"√({body})"
        if name in TEXT_COMMANDS:
            return self.argument(depth)
        if name in ("begin", "end"):
            self.argument(depth)
            return " "
        if name in ("left", "right", "big", "Big", "bigg", "Bigg", "limits", "nolimits", "displaystyle"):
            return ""
        if name in SYMBOLS:
            return SYMBOLS[name]
        if name == "\\":
            return "\n"
        return token[1:] if not name[:1].isalpha() else name

    def run(self, depth: int = 0) -> str:
        out = []
        while self.at < len(self.tokens):
            if self.tokens[self.at] == "}":
                self.at += 1
                if depth:
                    break
                continue
            out.append(self.step(depth))
        return "".join(out)


def math_body(text: str) -> str | None:
    """The inside of a text that is one delimited formula; None otherwise."""
    for pattern in (r"\$\$(.+?)\$\$", r"\\\[(.+?)\\\]", r"\\\((.+?)\\\)", r"\$([^$]+)\$"):
        if m := re.fullmatch(r"\s*" + pattern + r"\s*", text, re.S):
            return m[1].strip()
    return None


def linearize(text: str | None) -> str | None:
    """A formula as one line of plain text."""
    if text is None:
        return None
    body = math_body(text)
    out = _Reader(body if body is not None else text).run()
    return re.sub(r"[ \t]+", " ", re.sub(r"\s*&\s*", " ", out)).strip()


def simple_unicode(text: str | None) -> str | None:
    """A short formula as lossless text; None if anything of it would be lost."""
    body = (math_body(text or "") or text or "").strip()
    if not body or len(body) > 90 or re.search(r"\\(?:frac|dfrac|tfrac|sqrt|sum|int|prod|begin|matrix|left|right|over)", body):
        return None
    out = linearize(body)
    if not out or len(out) > 110 or re.search(r"[\\{}]", out) or re.search(r"[\^_]", out):
        return None
    return out


def is_substantive_math(text: str | None) -> bool:
    """Whether a formula's body is more than a citation: a structural command, or an operator and a letter or digit."""
    body = (text or "").strip()
    if re.fullmatch(r"[\^_]?\{?\s*\[?\d[\d,;\-– ]*\]?\s*\}?", body):
        return False
    return bool(re.search(r"\\(?:frac|sqrt|sum|int|prod|begin)", body)) or bool(re.search(r"[=+\-*/<>^_]", body) and re.search(r"[A-Za-z0-9]", body))


def replace_symbols(text: str | None) -> str | None:
    """Known commands as their characters, the rest unchanged."""
    if text is None:
        return None
    return re.sub(r"\\([A-Za-z]+)(?![A-Za-z])", lambda m: SYMBOLS.get(m[1], m[0]), text)


def document(formula: str) -> str:
    """A formula in a minimal document for an external typesetter."""
    body = math_body(formula) or formula
    return "\n".join(("\\documentclass{standalone}", "\\usepackage{amsmath,amssymb}", "\\begin{document}", f"$\\displaystyle {body}$", "\\end{document}", ""))
