"""Per-document text statistics, and the kind of each document: prose, list, table or junk.

Raw statistics are taken of every line and every document.  A Gaussian mixture is fitted by
expectation-maximisation on the standardised statistics of the lines of all documents; its components get their
kind from inspected example texts, and the kind of a document is what most of its characters belong to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_batches
from corpusloom.session import materialize

#: Common words of the six languages, which sentences need and items do not.
COMMON = frozenset(
    (
        "a à ao aos as às com da das de do dos e é em entre foi já mais mas na não nas no nos o os ou para pela pelo por porque que quando se sem seu sua um uma até após sobre segundo contra desde durante como ainda também "
        "al con contra cuando del desde el en es esta este hacia hasta la las lo los más no pero pues según sin su también tras un una y ya durante desde como todavía sobre "
        "about after against and at because before for from has in is it of on that the this to was when while with without during between also still together according "
        "au aux avec avant cette chez dans depuis des du elle en est et il le les mais ne où par pas pour puisque quand qui sa sans selon sur une pendant contre aussi encore comme vers "
        "aber am an auf aus bei das dem den der des die ein eine für gegen hat im ist mit nach ohne seit sich und von vor während weil wie zu zum zur laut zwischen auch noch über bis gegen hinter "
        "alla che ci con contro da dal dalla dei del della di dopo fino gli ha i il in la le ma nel nella non per perché più quando secondo senza si su un una contro durante anche ancora come tra insieme"
    ).split()
)
KINDS = ("prose", "list", "table", "junk")
#: Statistics of a line that the mixture is fitted on, with the value that is the top level of each; what is above counts as this.
FITTED = {
    "log_words": 4.5, "common_share": 1.0, "distinct_common": 8.0, "ends_with_stop": 1.0, "symbol_ratio": 0.5, "digit_ratio": 1.0, "vowel_ratio": 1.0, "mean_word_length": 16.0,
    "separators": 1.0, "bullet": 1.0, "colons": 1 / 3, "capitals": 1.0, "log_longest": 5.0, "numbers": 1.0, "distinct_words": 1.0,
}
TOPS = np.array(list(FITTED.values()))
#: Levels that each statistic is rounded to, so that equal lines share a cell and the mixture is fitted on counted cells.
LEVELS = 16
#: A document is of a kind that makes up this share of it.
SHARE = 2 / 3

_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"\t|\||;|\s[/·›]\s|\s{3,}|,(?=\S)")
_SYMBOL = re.compile(r"[{}<>=\\^~_$@#§¬&*+%\[\]]")
_STOP = re.compile(r"[.!?…»”\"'—]\s*$")
_BULLET = re.compile(r"\s*(?:[-–—*•·‣▪+o]|\(?\d{1,4}[.)]|\(?[a-zA-Z]{1,2}[.)]|\[\s*[xX]?\s*\])\s+(?=\S)")
_VOWELS = b"aeiou"


def _line(line: str) -> tuple[tuple[float, ...], int, int, int, int, int]:
    """The FITTED statistics of a line that is not blank; its words, letters, digits, common words and plain vowels."""
    words, tokens, body = _WORD.findall(line.lower()), line.split(), line.strip()
    n, m, joined = len(words), len(tokens), "".join(words)
    letters, digits = len(joined), sum(map(str.isdigit, body))
    size = max(sum(map(len, tokens)), 1)
    own = [w for w in words if w in COMMON]
    plain = joined.encode("ascii", "ignore")
    vowels = len(plain) - len(plain.translate(None, _VOWELS))
    numbers = sum(t[0].isdigit() or t[-1].isdigit() for t in tokens)
    return (
        np.log1p(n), len(own) / max(n, 1), len(set(own)), 1.0 if _STOP.search(line) else 0.0, len(_SYMBOL.findall(body)) / size, digits / size, vowels / len(plain) if plain else 0.45, letters / max(n, 1),
        len(_SEPARATOR.findall(body)) / m, 1.0 if _BULLET.match(line) else 0.0, body.count(":") / m, sum(t[0].isupper() for t in tokens) / m, np.log(max(map(len, tokens))), numbers / m, len(set(words)) / max(n, 1),
    ), n, letters, digits, len(own), vowels


def _levels(rows: list[tuple[float, ...]]) -> np.ndarray:
    """Statistics of lines in LEVELS."""
    values = np.array(rows, float).reshape(len(rows), len(FITTED))
    return np.rint(np.clip(values / TOPS, 0, 1) * LEVELS).astype(np.uint8)


#: Statistics of a document that are reported beside its shares.
STATISTICS = ("chars", "words", "lines", "mean_word_length", "symbol_ratio", "digit_ratio", "line_stop_share", "common_share", "vowel_ratio")


def _document(text: str, lines: dict[str, tuple]) -> tuple[dict[str, float], list[tuple[float, ...]], list[int]]:
    """The STATISTICS of a text, and the statistics and characters of its lines; ``lines`` remembers lines met before."""
    vectors, chars = [], []
    words = letters = digits = common = vowels = stops = plain = 0
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        known = lines.get(line)
        if known is None:
            if len(lines) >= MEMO:
                lines.clear()
            known = lines[line] = _line(line)
        vector, n, a, d, c, v = known
        vectors.append(vector)
        chars.append(len(line.strip()))
        words, letters, digits, common, vowels, stops = words + n, letters + a, digits + d, common + c, vowels + v, stops + vector[3]
    size = max(len("".join(text.split())), 1)
    plain = sum(c.isascii() and c.isalpha() for c in text) if vowels else 0
    values = (len(text), words, len(vectors), letters / max(words, 1), max(0.0, 1 - (letters + digits) / size) if vectors else 0.0, digits / size, stops / max(len(vectors), 1), common / max(words, 1), vowels / plain if plain else 0.0)
    return dict(zip(STATISTICS, map(float, values))), vectors, chars


def statistics(text: str) -> dict[str, float]:
    """All statistics of one text, its shares by a mixture of the EXAMPLES alone; zeros for a text without any visible character."""
    values, vectors, chars = _document(text, {})
    shares = np.array(chars, float) @ _of_examples().kind_posterior(_levels(vectors)) / sum(chars) if chars else np.zeros(len(KINDS))
    return values | {f"{k}_share": float(v) for k, v in zip(KINDS, shares)}


#: Lines whose statistics a worker remembers.
MEMO = 100_000
#: Inspected examples: texts of which every line is plainly of the kind.  They seed the mixture and give its components their kinds.
EXAMPLES = (
    ("prose", "The council met on Monday and decided that the bridge will be repaired before the winter. Nobody spoke against it.\nAfter the meeting the mayor thanked the families that had waited for so long.\nWhen the rain stopped, the children went back to the garden.\nShe did not know whether the letter had arrived"),
    ("prose", "A prefeitura anunciou que a ponte será recuperada antes do inverno, porque os moradores esperam há anos. Segundo o relatório, a obra custa pouco.\nNa semana passada, o conselho aprovou o projeto.\nO rio subiu durante a noite e a escola ficou fechada até sexta-feira."),
    ("prose", "EL CONSEJO APROBÓ EL PRESUPUESTO DE LA CIUDAD Y LA ESCUELA RECIBIÓ A LOS ALUMNOS DESPUÉS DE LA LLUVIA\nEl mercado volvió a abrir con poca gente\nTHE OLD LIBRARY OF THE TOWN WAS OPENED AGAIN AFTER THE LONG WINTER AND MANY PEOPLE CAME TO SEE IT."),
    ("prose", "The river in the valley rose again, and the people from the old town waited for the water to fall. It took three days.\nLe maire a dit que la gare serait ouverte avant la fin de l'année, mais le budget n'est pas encore voté.\nLes habitants du quartier ont attendu plus de 200 jours pour retrouver leur bibliothèque."),
    ("prose", "Der Verein hat die Sammlung für das Museum bezahlt, weil die Gemeinde kein Geld hatte.\nSeit dem Winter ist die Schule mit dem neuen Dach wieder für alle offen.\nIn diesem Jahr kamen mehr als 1.200 Besucher in das kleine Haus am Fluss."),
    ("prose", "Il sindaco ha detto che la strada sarà chiusa fino alla fine di marzo, perché il ponte non è sicuro.\n\"Non abbiamo mai visto una pioggia così\", raccontano i vecchi del paese.\nSecondo il giornale, nella città vecchia sono rimasti in pochi."),
    ("prose", "the mill by the lake was sold to a family from the coast that wants to bake bread there again\nwe walked along the shore until it was dark and then we took the last bus to the city\nnobody had told them that the road over the hill was closed for the whole winter and that the only way was by boat"),
    ("prose", "O clube da vila ganhou o jogo com um gol no último minuto\nHe said that it was over.\nIs there anyone who knows why the lights went out?\nPor la tarde, la plaza se llenó de gente que quería ver la nueva fuente, y no quedó ni una silla libre."),
    ("prose", "The harbour moved 4,310 tons in May, about 12% more than in the year before, according to the report of the port.\nNo ano de 2018, a cooperativa vendeu 350 mil litros de leite para as escolas da região.\nThe cafÃ© in the main street was closed because the owner had no money for the rent."),
    ("prose", "— The old mill is closed —, said the owner, and he went home without a word.\n— A chuva veio cedo — disse a vizinha sobre a festa da praça.\no barco ficou parado no cais depois da tempestade\nIn March, the port changed the rules without the town, because the old ones were unclear to most of the crews and to the families on the shore, who had asked for years to be heard before anything was decided.\nL'école du village sera fermée cet été pour que les ouvriers puissent changer le toit, mais les enfants iront dans une autre école, dit la mairie.\n- Nobody in the town had seen the ship before it came to the shore, said the fisherman."),
    ("prose", "When the new line was opened after eleven years of work, the people of the valley came down to the small station with flags and baskets, and the oldest of them said that they had not believed that a train would ever stop there, because so many plans had been made and given up before, and because the money that the region had promised was spent on a road that nobody uses, so that in the end it was the town itself that paid for most of the tunnel and for the two bridges over the river.\nQuando a nova linha foi aberta depois de onze anos de obras, os moradores do vale desceram até a pequena estação com bandeiras e cestas, e o mais velho deles disse que não acreditava que um trem fosse parar ali, porque muitos planos foram feitos e abandonados antes, e porque o dinheiro que a região havia prometido foi gasto com uma estrada que ninguém usa."),
    ("list", "- apples from the hill\n- oranges 12\n- bread\n- Mira Colan\n- salt and sugar\n- green tea\n- Vando Rilo 8\n- winter coats"),
    ("list", "1. Lupa Torim\n2. kitchen table\n3. wet paint\n4. Garo Belim 171\n5. blue door\n6. song Melari\n12. Rana Tovo\n23) old stamps"),
    ("list", "Home › News › Park Lumo\nHome › Region › School Vira\nStart › Sport › Verein Talo\nInicio › Videos › Puerto Neva › 2019"),
    ("list", "Dorim Vela 12\nTano Pira\nmuseum Kiva\nVelo Santim 881\nharbour Riko\nMolo Tarka\nspring flowers\nRiva\nGrande Torre Nilo\nbakery Simo 4"),
    ("list", "* contact\n* about us\n* imprint and privacy\n* jobs\n• river cruise\n• city tour Lana\n• night market\n+ extras 3\n– Rolo Mita"),
    ("list", "a) lemon cake\nb) plum tart\nc) rye bread Kolo\n(1) first floor\n(2) second floor\n[x] milk\n[ ] butter\n[ ] Vena Tiro 5"),
    ("list", "- the door behind the trees Padola\n- der Hof an der Brücke Lomi\n- a casa do rio Vanti\nShare this page: Feed | Mail\nRead more in Norva Bepi\nSubscribe to the newsletter\nNews\nSport\nLocal elections\nWeather\nContact\nLogin\nMais lidas\nÚltimas notícias\nImpressum\nFotos e vídeos"),
    ("list", "• tomatoes • onions • garlic • olive oil • Rana salt\n1. Kilo 2. Vano 3. Toru 4. Selim 5. Brago 6. Nuri\n- milk - eggs - flour - butter - Rilo sugar"),
    ("table", "Name\tYear\tShare\tCity\nMila Dorva\t2019\t35%\tTolka\nTesa Colan\t2020\t71%\tRavi\nPelo Santi\t2021\t-\tKiso\nsum\t6060\t106%\t3"),
    ("table", "Brand: Colan\nColour: 1204\nWeight: 12,50\nOrigin: Vela Rimo\nWarranty: 24\nPhone: 555 0199\nSize: 40 x 60\nModel: TX-900\nAuthor: Rena Miro\nDate: 12/05/2017"),
    ("table", "Price: 30 | Brand: Mila | Code: 7781 | Size: 12,5 | Origin: Ravi\nAge: 7; Weight: 20; City: Nola; Team: Rivo\nStock: 18 | Colour: red | Shelf: 4"),
    ("table", "School Mira;Survey Talo;Index Nevo\nTesa;12/07/2025;71941\nPelo Kiso;02/06/2020;19112\nDorva;23/11/2019;2210\nyear;count;share\n2012;33;0,5"),
    ("table", "| team | played | won | points |\n| Rivo | 12 | 7 | 22 |\n| Santo Kela | 12 | 6 | 20 |\n| Norda | 11 | 2 | 8 |"),
    ("table", "2015  120  33,5  8%\n2016  131  30,1  9%\nVela   44   12   1,5\nRimo   51   18   2,0\nNova Tirana   640   22,4   31%\nTotal   1,204   100"),
    ("table", "12.05.2020 14:30 22,5 C\n03/04/2018 45.20 +1.5%\nJan 10 12 9 14\nMar 22 25 19 30\nMon 08:00 17:30\nRivo 3 Santo 1\nTirana 12,5 14,0 13,2"),
    ("table", "Vela, Mira,1982,Kiso\nsku,name,price\n1001,lamp,25.90\n1002,chair,79.00\nLuno / Tarka / Rimo / Vela\nSagi / Meti / 48101\n| Tropa | 41% | 62% | Tira | 3% |\n12 / 14 / 9 / 30"),
    ("junk", "xkqv bvtrz plmnw qrtz zzkjh bdfgh mnbvc qwrtp\nlkjhg zxcvb trwqp vbnmk hgfds plkmj\nwrtkl pqzxv mnrtb\nqqkx zrtw bvnm ghjkl tfrds wqpzk xcvbn\nsdfg hjkl qwrt zxcv\ntrplkqwvb zxcdfg mnbhjk wrtplksd qvbcnm hgfjdksl zzqwrt plmkjn bvcxzlkj tgbrfv\nkjhgfdswq bn vcxrtplm gh dfsqwzxkl mnbvcr tq wsdfgplk jhrt xcvbnmkl qwrtpsdfgh zx lkjhgv bnmtr wqplk sdfghj\nvbnmkljhg fdsrtwq plkjhmnbv"),
    ("junk", "^!+~[%-]*~>|\n-}_%?%@^&$}+#=|<!#>?*{&*~=_=$!~@-{{?!!!&=>\n=====*****=====\n#@!~%%^&*()_+|}{\n<><><>[][]{}~~~"),
    ("junk", "if(typeof abc!=='undefined'){window.def='34872';}\n.box-red{margin:8px auto;padding:0;display:none}\nvar x=y||{};x.push(function(){y.init(4729);});\nfunction go(a){return a?b(a):null}\n<div class=\"row\"><span id=\"k2\">0</span></div>\n@media (max-width:600px){.nav{display:none}}"),
    ("junk", "hotel mila cheap flights ravi coupon tolka hotel dorva discount pelo cheap flights kiso credit tesa online santi coupon colan\nbuy online cheap discount shoes buy shoes online cheap sale shoes discount\nloan credit loan fast loan online credit card loan bank fast\nseguro barato hotel viagem desconto passagem hotel barato seguro online"),
    ("junk", "&gt;Top%20&#160;Mel\\u00eRila&lt;br&gt;\\u00eVob&#x27;41&lt;br&gt;Nur&#160;Lin%2033&lt;br&gt;Pod&gt;&#160;12\n%3Cdiv%3E%20%26nbsp%3B%E2%80%A6%3C%2Fdiv%3E\n&nbsp;&nbsp;&amp;quot;&lt;p&gt;"),
    ("junk", "Rk9vQmFyMTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3BxcnN0dXZ3eHl6QUJDREVG\nq7Zt/Lw0Xn3+YbR5kGm2Vd8Jc4Hs9Pf1Ta6UeKoWiBxMz==\n4f8a1c0e9b7d3265ff01ab98cd76ef54a0b1c2d3e4f56789\neyJhbGciOiJIUzI1NiJ9.eyJ1c2VyIjo0Mn0"),
    ("junk", "81920344 17 55021 90213 6 331872 4400917\n7731250 48 2 90551 1138 64201 73\n5 0021887 913 4 77120 38 560193\n40982 1 7765 33 902817 2 60 11873"),
)
ROUNDS = 15
RIDGE = 0.02
#: Variance, in squared deviations, and weight that a component begins with; a component keeps both where no line is left to it.
START_VARIANCE = 0.25


def document_statistics(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, statistics..., cells, line_chars)`` of every document, once per id.

    ``cells`` holds the levels of the FITTED statistics, a byte each, of its lines that are not blank, and ``line_chars``
    their characters.  Rows with null id or null text are no documents; empty or blank texts have zeros throughout.
    """

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"id": batch.column(0).to_pylist()} | {k: [] for k in (*STATISTICS, "cells", "line_chars")}
        lines: dict[str, tuple] = {}
        for text in batch.column(1).to_pylist():
            values, vectors, chars = _document(text, lines)
            for k, v in values.items():
                out[k].append(v)
            out["cells"].append(_levels(vectors).tobytes())
            out["line_chars"].append(chars)
        return out

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return map_batches(src, "id long, " + ", ".join(f"{k} double" for k in STATISTICS) + ", cells binary, line_chars array<int>", step).dropDuplicates(["id"])


@dataclass
class Mixture:
    """A mixture of Gaussians with diagonal covariance over standardised statistics of lines."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    kinds: list[str]

    def standard(self, cells: np.ndarray) -> np.ndarray:
        return (cells / LEVELS - self.centre) / self.scale

    def posterior(self, z: np.ndarray) -> np.ndarray:
        """Probability of each component for standardised statistics."""
        ld = np.log(self.weight) - 0.5 * ((z * z) @ (1 / self.var).T - 2 * z @ (self.mean / self.var).T + (self.mean**2 / self.var + np.log(self.var)).sum(axis=1))
        p = np.exp(ld - ld.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def kind_posterior(self, cells: np.ndarray) -> np.ndarray:
        member = np.array([[kind == k for k in KINDS] for kind in self.kinds], float)
        distinct, where = np.unique(cells.reshape(-1, len(FITTED)), axis=0, return_inverse=True)
        return (self.posterior(self.standard(distinct)) @ member)[where.reshape(-1)]


@lru_cache(maxsize=1)
def _examples() -> tuple[np.ndarray, list[str]]:
    """Distinct cells of the example lines, and their kinds."""
    own = [(kind, line) for kind, text in EXAMPLES for line in text.split("\n") if line.strip()]
    cells, first = np.unique(_levels([_line(line)[0] for _, line in own]), axis=0, return_index=True)
    return cells, [own[i][0] for i in first]


@lru_cache(maxsize=1)
def _of_examples() -> Mixture:
    cells, kinds = _examples()
    x = cells / LEVELS
    m = Mixture(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-2), np.full(len(x), 1 / len(x)), np.zeros(x.shape), np.full(x.shape, START_VARIANCE), kinds)
    m.mean = m.standard(cells)
    return m


def _counted_cells(stats: DataFrame) -> DataFrame:
    """``(cell, n)``: the lines of all documents by cell, counted inside each batch first."""
    width = len(FITTED)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"V{width}")
        distinct, n = np.unique(cells, return_counts=True)
        return {"cell": [c.tobytes() for c in distinct], "n": n.tolist()}

    return map_batches(stats.filter("lines > 0").select("cells"), "cell binary, n long", step).groupBy("cell").agg(F.sum("n").alias("n"))


def _sums(cells: DataFrame, weigh) -> np.ndarray:
    """Sums over all cells of the matrices that ``weigh(levels, n)`` gives, (rows, 1 + 2 x statistics): a row goes to the driver."""
    names = [f"v{i}" for i in range(1 + 2 * len(FITTED))]

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        levels = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(FITTED))
        total = weigh(levels, batch.column(1).to_numpy().astype(float))
        return {"row": list(range(len(total)))} | {c: total[:, i].tolist() for i, c in enumerate(names)}

    rows = map_batches(cells, "row int, " + ", ".join(f"{c} double" for c in names), step).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([[r[c] for c in names] for r in sorted(rows, key=lambda r: r["row"])]).reshape(len(rows), len(names))


def fit_mixture(stats: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximisation over the lines of all documents, one component for each inspected example to begin with.

    A round is one pass over the counted cells; what goes to the driver is one row for each component.
    An empty input gives a single standard component.
    """
    cells, d = materialize(_counted_cells(stats), "line-cells"), len(FITTED)
    one = _sums(cells, lambda x, n: np.concatenate(([n.sum()], n @ (x / LEVELS), n @ (x / LEVELS) ** 2))[None])
    if not len(one):
        return Mixture(np.zeros(d), np.ones(d), np.ones(1), np.zeros((1, d)), np.ones((1, d)), ["prose"])
    n, centre, square = one[0, 0], one[0, 1 : d + 1] / one[0, 0], one[0, d + 1 :] / one[0, 0]
    seeds, _ = _examples()
    k = len(seeds)
    m = Mixture(centre, np.sqrt(np.maximum(square - centre**2, 1e-4)), np.full(k, 1 / k), np.zeros((k, d)), np.full((k, d), START_VARIANCE), [])
    m.mean = m.standard(seeds)
    for _ in range(rounds):

        def expect(x: np.ndarray, n: np.ndarray, m: Mixture = m) -> np.ndarray:
            z = m.standard(x)
            r = m.posterior(z) * n[:, None]
            return np.concatenate((r.sum(axis=0)[:, None], r.T @ z, r.T @ (z * z)), axis=1)

        got = _sums(cells, expect)
        total = got[:, :1]
        held = total > 1e-3
        mean = np.where(held, got[:, 1 : d + 1] / np.maximum(total, 1e-9), m.mean)
        var = np.where(held, np.maximum(got[:, d + 1 :] / np.maximum(total, 1e-9) - mean**2, 0) + RIDGE, m.var)
        weight = total[:, 0] + 1e-6
        m = Mixture(m.centre, m.scale, weight / weight.sum(), mean, var, [])
    return _named(m)


def _named(m: Mixture) -> Mixture:
    """Give each component the kind of the inspected examples that fall to it, or else of the nearest one."""
    cells, kinds = _examples()
    z = m.standard(cells)
    p = m.posterior(z)
    votes = np.stack([p[np.array(kinds) == k].mean(axis=0) for k in KINDS])
    nearest = ((z[:, None, :] - m.mean[None]) ** 2).sum(axis=2).argmin(axis=0)
    m.kinds = [KINDS[votes[:, j].argmax()] if votes[:, j].max() > 1e-3 else kinds[nearest[j]] for j in range(len(m.weight))]
    return m


def classify(stats: DataFrame, m: Mixture) -> DataFrame:
    """``stats`` without its cells, with the share of each kind in the characters of its lines, its ``kind`` and ``confidence``.

    The kind is the one with the largest share, which is the confidence; a document without visible text has the kind null.
    """
    names = [n for n in stats.columns if n not in ("cells", "line_chars")]
    types = dict(stats.dtypes)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        chars = column["line_chars"]
        sizes = np.diff(chars.offsets.to_numpy())
        weights = chars.flatten().to_numpy().astype(float)
        share = np.zeros((batch.num_rows, len(KINDS)))
        if len(weights):
            levels = np.frombuffer(b"".join(column["cells"].to_pylist()), np.uint8)
            np.add.at(share, np.repeat(np.arange(batch.num_rows), sizes), m.kind_posterior(levels) * weights[:, None])
        total = share.sum(axis=1)
        share /= np.maximum(total, 1e-9)[:, None]
        kinds = pa.array([KINDS[j] if s else None for j, s in zip(share.argmax(axis=1), total > 0)], pa.string())
        arrays = [*(column[c] for c in names), *(pa.array(share[:, j]) for j in range(len(KINDS))), kinds, pa.array(share.max(axis=1))]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *(f"{k}_share" for k in KINDS), "kind", "confidence"])

    ddl = ", ".join(f"{n} {types[n]}" for n in names)
    return map_batches(stats, ddl + "".join(f", {k}_share double" for k in KINDS) + ", kind string, confidence double", step)


def page_kinds(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, statistics..., shares..., kind, confidence)`` of every document."""
    stats = materialize(document_statistics(df, id_col, text_col), "text-statistics")
    return classify(stats, fit_mixture(stats))


def found(df: DataFrame, share: float = SHARE, **kw) -> DataFrame:
    """``(id, kind)`` of each document of which lines of kind list, table or junk by the mixture make up ``share`` at least."""
    return page_kinds(df, **kw).filter((F.col("kind") != "prose") & (F.col("confidence") >= share)).select("id", "kind")
