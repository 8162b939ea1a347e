from collections import Counter

import pytest

from tesela.llm import pii

SAMPLE = [
    "Me llamo Marta Valdelejo Fontamora y la plaza estaba llena. ¿Conoces a Julián Fontamora? Mi vecina Rosa Valdelejo vivía aquí al lado.",
    "Con Iker Fontamora y con N. Valdelejo nadie hablaba. Ni Amparo ni Teo Fontamora decían nada. Rosa era el vestido, no rojo.",
    "La virgen del Carmen y la rosa del patio, eso recuerdo. Con esperanza y con dolores de rodilla, la plaza dormía. La rosa.",
    "Escríbame a marta.valde@correo.example. Mi número es el 671-452-594, pero no. Llámame al +34 772 967 998 o al siete dos nueve ocho ocho siete cero uno cinco.",
    "Firmado por Hugo Valdelejo, con DNI 96458139 T. El documento, creo que era X-3851958-T, se perdió. Vivimos años en C/ Mayor de Abajo, 91, 8.º D, y ya.",
    "En el expediente 2019/00393 ponía que no. Éramos 912 450 personas. El lote 55-93312 llegó el 12/03/1988. Cobraba 8.919 euros.",
    "Nos mudamos a plaza del Molino Hondo, s/n, Villarmena cuando llovía. La calle Mayor de Abajo estaba vacía y fría. En camino Largo km 17 había pan.",
    None,
    "",
] * 4


@pytest.fixture(scope="module")
def finder():
    return pii.train(SAMPLE)


@pytest.mark.parametrize(
    "text,found",
    [
        ("Me llamo Lucía Fontamora y canto.", [("nombre", "Lucía Fontamora")]),
        ("El Dr. Valdelejo Fontamora, Marta me dijo", [("nombre", "Valdelejo Fontamora, Marta")]),
        ("¿Conoces a N. L. Valdelejo?", [("nombre", "N. L. Valdelejo")]),
        ("me llamo marta valdelejo y canto", [("nombre", "marta valdelejo")]),
        ("Mi prima AMPARO FONTAMORA, que en paz descanse", [("nombre", "AMPARO FONTAMORA")]),
        ("Rosa era el vestido, no rojo, y ya.", []),
        ("La virgen del Carmen y la rosa del patio", []),
        ("Con esperanza y con dolores de rodilla", []),
        ("Apunta mi correo, hugo_font05 (arroba) mail.ejemplo.example, y ya", [("email", "hugo_font05 (arroba) mail.ejemplo.example")]),
        ("邮箱是nieves.val＠buzon.test。我", [("email", "nieves.val＠buzon.test")]),
        ("ana arroba cartas punto invalid. Y", [("email", "ana arroba cartas punto invalid")]),
        ("En el grupo @vecinas_unidas ponían", []),
        ("Mi número es el (+34) 629 69 86 44, pero", [("telefono", "(+34) 629 69 86 44")]),
        ("pintaba poco (+34 638 337 753). El", [("telefono", "+34 638 337 753")]),
        ("电话是+52 55 3202 3354。", [("telefono", "+52 55 3202 3354")]),
        ("al seis cero cero cero ocho dos seis dos cuatro o", [("telefono", "seis cero cero cero ocho dos seis dos cuatro")]),
        ("Los papeles decían 72.014.688-L y la", [("documento", "72.014.688-L")]),
        ("con DNI PZC426569. La", [("documento", "PZC426569")]),
        ("creo que era 71/66318554/22, se", [("documento", "71/66318554/22")]),
        ("En el expediente 2019/00393 ponía; Éramos 912 450 personas; El lote 55-93312 llegó el 12/03/1988", []),
        ("cerca de Avda. Puente Largo n.º 105, 08600 Torrezuela. Y", [("direccion", "Avda. Puente Largo n.º 105, 08600 Torrezuela")]),
        ("La calle Mayor de Abajo estaba vacía y 24 eran", []),
        ("En CALLE DE LAS HILANDERAS 47 había", [("direccion", "CALLE DE LAS HILANDERAS 47")]),
        ("en camino Largo km 16 cuando", [("direccion", "camino Largo km 16")]),
    ],
)
def test_mentions(finder, text, found):
    assert [(k, text[s:e]) for s, e, k in finder.mentions(text)] == found


def test_the_rest_of_the_text_stays(finder):
    text = "Datos:  Marta Valdelejo / +34 772 967 998 / marta.v@correo.example\n¡Y ya!"
    assert finder.replaced(text) == "Datos:  [NOMBRE] / [TELEFONO] / [EMAIL]\n¡Y ya!"
    assert finder.replaced(None) is None and finder.replaced("") == "" and finder.mentions(None) == []
    long = "nada que ver " * 20_000
    assert finder.replaced(long) == long


def test_reliabilities_tell_good_labelers_from_bad():
    import numpy as np

    r = np.random.default_rng(1)
    truth = r.random(2000) < 0.5
    votes = np.array([np.where(r.random(2000) < a, truth * 2 - 1, 1 - truth * 2) for a in (0.95, 0.9, 0.6)]).T.astype(float)
    votes[r.random(votes.shape) < 0.3] = 0
    p, reliability = pii.aggregate_votes(votes, np.ones(2000))
    assert reliability[0] > reliability[1] > reliability[2] and ((p > 0.5) == truth).mean() > 0.85


def test_given_names_are_learned():
    more = ["Me llamo Zoraida Fontamora y canto.", "¿Conoces a Zoraida Valdelejo?", "Doña Fontamora Valdelejo, Zoraida recibía cartas."] * 4
    finder = pii.train(SAMPLE + more)
    text = "Con Zoraida Valdelejo y con Iker nadie hablaba."
    assert [text[s:e] for s, e, _ in finder.mentions(text)] == ["Zoraida Valdelejo", "Iker"]


# Texts of no table and no template, with what is to be found in them.
HELD_OUT = [
    ("My name is Arthur Pendle and I live at 221 Baker Street.", [("nombre", "Arthur Pendle"), ("direccion", "221 Baker Street")]),
    ("Please call (555) 123-4567 before noon, or +1 555 987 6543.", [("telefono", "(555) 123-4567"), ("telefono", "+1 555 987 6543")]),
    ("Her SSN is 123-45-6789 and she pays on time.", [("documento", "123-45-6789")]),
    ("They moved to 12 Main Street with Mary Cole.", [("direccion", "12 Main Street"), ("nombre", "Mary Cole")]),
    ("Contact: a.very.long.local.part.that.goes.on.and.on.and.on.and.on.until.it.is.quite.long.indeed.really@mail.example now", [("email", "a.very.long.local.part.that.goes.on.and.on.and.on.and.on.until.it.is.quite.long.indeed.really@mail.example")]),
    ("Herr Klaus Oberhauser wohnt in der Hauptstraße 12 in Ulm.", [("nombre", "Klaus Oberhauser"), ("direccion", "Hauptstraße 12")]),
    ("Rufen Sie 030 7654321 an, sagte Petra Lang.", [("telefono", "030 7654321"), ("nombre", "Petra Lang")]),
    ("Sophie Marchand habite 14, rue des Lilas, depuis mars.", [("nombre", "Sophie Marchand"), ("direccion", "14, rue des Lilas")]),
    ("Mon numéro est le 06 12 34 56 78, dit Pierre.", [("telefono", "06 12 34 56 78"), ("nombre", "Pierre")]),
    ("Mi cuñado Eduardo Villamil perdió el DNI 48.123.456-Q en la feria.", [("nombre", "Eduardo Villamil"), ("documento", "48.123.456-Q")]),
    ("Trabaja con Lucía Ferrán en la calle Olmo 23, 3.º B, y duerme poco.", [("nombre", "Lucía Ferrán"), ("direccion", "calle Olmo 23, 3.º B")]),
    ("Mándelo a l.ferran+trabajo@correo.example o a luz_gil@buzon.test hoy.", [("email", "l.ferran+trabajo@correo.example"), ("email", "luz_gil@buzon.test")]),
    ("El pasaporte AAB123456 caducó y la tarjeta de residente X-1234567-L también.", [("documento", "AAB123456"), ("documento", "X-1234567-L")]),
    ("Nos atendió la doctora, la Dra. Quiroga, en Avda. de los Pinos, 7.", [("nombre", "Quiroga"), ("direccion", "Avda. de los Pinos, 7")]),
    ("O Sr. Paulo Teixeira mora na rua do Carmo, 33, telefone 912 345 678.", [("nombre", "Paulo Teixeira"), ("direccion", "rua do Carmo, 33"), ("telefono", "912 345 678")]),
    ("Ho visto Giulia Ricci in via Garibaldi 8 ieri.", [("nombre", "Giulia Ricci"), ("direccion", "via Garibaldi 8")]),
    ("Teléfono de casa: 91 555 12 34; móvil 655 12 34 56.", [("telefono", "91 555 12 34"), ("telefono", "655 12 34 56")]),
    ("Firmado: Tomás Egea Ruiz, NIF 12345678Z.", [("nombre", "Tomás Egea Ruiz"), ("documento", "12345678Z")]),
    ("escríbele a pepe (at) casa (dot) example si puedes", [("email", "pepe (at) casa (dot) example")]),
    ("La cédula 1.234.567 es de Ramón Ibarra.", [("documento", "1.234.567"), ("nombre", "Ramón Ibarra")]),
    ("En 1998 costaba 4.500 euros y pesaba 12 kg; véase la página 33-45.", []),
    ("The Main Street was empty and Boston played 3-2 on 12/05/2019.", []),
    ("El expediente 2020/004512, lote 4455-221, del Banco Central del Río.", []),
    ("We drove 450 miles to San Diego in 2014 and paid $1,200.", []),
]


def test_held_out_texts(finder):
    """Nine mentions in ten of each kind, and as few false ones, in texts the finder was not trained on."""
    due, found, right = Counter(), Counter(), Counter()
    for text, want in HELD_OUT:
        got = [(k, text[s:e]) for s, e, k in finder.mentions(text)]
        due.update(k for k, _ in want)
        found.update(k for k, _ in got)
        right.update(k for k, v in got if (k, v) in want)
    assert all(right[k] >= 0.9 * due[k] and right[k] >= 0.9 * found[k] for k in pii.KINDS), (due, found, right)


def test_words_are_counted_over_all_texts(spark):
    """The counts of a table are those of its texts in hand, whatever its partitions; texts beyond the sample teach names too."""
    more = ["Me llamo Zoraida Fontamora y canto.", "¿Conoces a Zoraida Valdelejo?", "Se llamaba Zoraida Valdelejo."] * 4
    rows = [("t", str(i), t) for i, t in enumerate(SAMPLE + more)]
    texts = spark.createDataFrame(rows, "tabla string, clave string, texto string").repartition(3)
    far, near = pii.learn_words(texts.where("texto is not null")), pii.count_words(SAMPLE + more)
    assert (far.givens, far.surnames, far.common, far.plain) == (near.givens, near.surnames, near.common, near.plain) and "zoraida" in far.givens
    finder = pii.train_on(texts.where("int(clave) < 36"), "clave", "texto", far)
    text = "Con Zoraida Valdelejo y con Iker nadie hablaba."
    assert [text[s:e] for s, e, _ in finder.mentions(text)] == ["Zoraida Valdelejo", "Iker"]
    nothing = pii.learn_words(texts.limit(0))
    assert not (nothing.givens or nothing.surnames or nothing.common or nothing.plain)


def test_long_names_and_addresses(finder):
    street = "calle de la Virgen de los Milagros de la Sierra del Pozo Alto de Arriba"
    for text, want in ((f"Vive en {street} 12 y ya.", [("direccion", f"{street} 12")]), ("Me llamo María Luisa Valdelejo Fontamora y canto.", [("nombre", "María Luisa Valdelejo Fontamora")])):
        assert [(k, text[s:e]) for s, e, k in finder.mentions(text)] == want
    assert finder.mentions("@" * 5000 + "a" * 5000) == [] and finder.mentions("ana@" * 3000) is not None


def test_untrained_on_nothing():
    finder = pii.train([])
    assert finder.mentions("Sin nada.") == []


def test_frames(spark, finder):
    rows = [("t", "1", "Mi número es el 671-452-594, pero", "x"), ("t", "1", "Mi número es el 671-452-594, pero", "x"), ("t", "2", None, "y"), ("t", "3", "", "z")]
    texts = spark.createDataFrame(rows, "tabla string, clave string, texto string, tipo string")
    assert pii.find_mentions(texts, finder).distinct().collect() == [("t", "1", "telefono", 16, 27)]
    assert [r["texto"] for r in pii.replace_mentions(texts, finder).orderBy("clave").collect()][2:] == [None, ""]
    assert pii.find_mentions(texts.limit(0), finder).count() == 0
    assert pii.train_on(texts, "clave", "texto").mentions("hola") == []
