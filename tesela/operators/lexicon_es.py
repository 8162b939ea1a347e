"""Spanish closed-class words. Fixed values, in natural order."""

from __future__ import annotations

NEGATORS = "no nunca jamás tampoco ni".split()
NEGATIVE_POLARITY = "nadie nada ningún ninguna ninguno jamás tampoco ni".split()
NPI_IDIOMS = ["nada más", "nada que ver", "nadie dice nada", "sin nada", "nada menos", "nada del otro mundo", "nada de eso", "nada más y nada menos"]
NON_REFERENTIAL = "que quien quienes cual cuales cuyo cuya qué quién cómo cuándo dónde cuánto todo nada algo nadie alguien".split()
PERIPHRASIS_VERBS = "ir acabar deber poder querer soler haber estar seguir andar echar tener llevar dejar ponerse".split()
QUANTIFIERS = {
    "UNIVERSAL": "todo toda todos todas cada ambos ambas sendos sendas".split(),
    "EXISTENCIAL": "algún alguna algunos algunas cierto cierta ciertos ciertas".split(),
    "NEGATIVO": ["ningún", "ninguna", "ningunos", "ningunas", "ni un", "ni una", "nada", "nadie"],
    "PROPORCIONAL": "mucho mucha muchos muchas poco poca pocos pocas bastante bastantes demasiado demasiada demasiados demasiadas algo harto hartos hartas".split(),
}
PARTITIVES = "montón pila sinfín puñado chorro cantidad grupo mayoría minoría".split()
ADVERBS = {
    "tiempo": ["ayer", "hoy", "mañana", "pronto", "tarde", "temprano", "siempre", "nunca", "jamás", "ahora", "luego", "antes", "después", "ya",
        "todavía", "aún", "de repente", "de inmediato", "de pronto", "en seguida"],
    "lugar": ["aquí", "ahí", "allí", "allá", "acá", "cerca", "lejos", "arriba", "abajo", "delante", "detrás", "dentro", "fuera", "encima", "debajo",
        "al lado", "en frente", "de cerca", "de lejos"],
    "modo": ["bien", "mal", "así", "despacio", "deprisa", "rápido", "claro", "igual", "peor", "mejor", "de buen grado", "de mala manera",
        "a propósito", "de tal manera", "por supuesto"],
    "frecuencia": ["a menudo", "de vez en cuando", "con frecuencia", "rara vez"],
    "grado": ["muy", "mucho", "mucha", "poco", "bastante", "demasiado", "casi", "más", "menos", "tan", "tanto", "nada", "apenas", "un poco",
        "un montón", "en absoluto", "por completo"],
    "epistemico": ["quizá", "quizás", "acaso", "seguramente", "probablemente", "posiblemente", "supuestamente"],
    "comparativo": ["cada vez más", "cuanto más", "más que", "menos que"],
    "foco": ["solo", "solamente", "únicamente", "exclusivamente", "precisamente", "más que todo", "más que nada"],
    "conjuntivo": ["además", "asimismo", "sin embargo", "no obstante", "por consiguiente", "por lo tanto", "así que", "por eso", "en cambio"],
    "orientado_hablante": ["francamente", "sinceramente", "lamentablemente", "afortunadamente", "honestamente", "claramente", "obviamente",
        "a decir verdad", "en realidad", "por desgracia"],
    "orientado_sujeto": ["a sabiendas", "de forma deliberada", "con cuidado", "sin querer"],
    "dominio": ["técnicamente", "políticamente", "económicamente", "socialmente", "legalmente", "generalmente", "básicamente", "fundamentalmente",
        "principalmente", "en general", "en particular", "en teoría", "en la práctica"],
}
ADVERBS_BLOCKED = "no sí si ya".split()
LOCUTIONS = {
    "REFORMULADORES": ["o sea", "es decir", "en otras palabras", "mejor dicho"],
    "ESTRUCTURADORES": ["por un lado", "por otro lado", "en fin", "por cierto"],
    "ARGUMENTATIVOS": ["sin embargo", "por lo tanto", "en el fondo", "a fin de cuentas", "por ejemplo", "en cuanto a", "más que todo", "sobre todo"],
    "CONVERSACIONALES": ["lo que pasa es que", "la cosa es que", "pues nada", "ya ves"],
}
CONNECTORS = "además asimismo entonces luego finalmente encima incluso tampoco también así bueno pues".split()
INSUBORDINATION = {"que": "EXCLAMATIVA_JUSIVA", "si": "REFUTATIVA", "pero si": "REFUTATIVA", "como": "ADVERTENCIA"}
#: Where a conjunction has several readings, the last one given counts.
SUBORDINATORS = {
    "que": ("completiva", None), "cuando": ("adverbial", "temporal"), "mientras": ("adverbial", "temporal"), "antes": ("adverbial", "temporal"),
    "después": ("adverbial", "temporal"), "apenas": ("adverbial", "temporal"), "porque": ("adverbial", "causal"), "pues": ("adverbial", "causal"),
    "ya que": ("adverbial", "causal"), "si": ("adverbial", "condicional"), "aunque": ("adverbial", "concesiva"), "a pesar de": ("adverbial", "concesiva"),
    "según": ("adverbial", "modal"), "como": ("comparativa", None), "cuanto": ("comparativa", None),
}
POSSESSIVES = "mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas".split()

# Closed classes for the built-in tagger.
ARTICLES = "el la los las un una unos unas lo".split()
PREPOSITIONS = "a ante bajo con contra de desde durante en entre hacia hasta mediante para por según sin sobre tras".split()
PRONOUNS = "yo tú él ella usted nosotros nosotras vosotros vosotras ellos ellas ustedes me te se nos os le les mí ti sí conmigo contigo consigo".split()
CONJUNCTIONS = "y e o u ni pero sino".split()
AUXILIARIES = "he has ha hemos habéis han había habías habíamos habían haya hayan es son era eran fue fueron está están estaba estaban".split()
INTERJECTIONS = "ay ah oh eh bueno vaya".split()
CLITIC_PRONOUNS = "me te se nos os le les".split()
REFLEXIVES = "se sí consigo".split()
