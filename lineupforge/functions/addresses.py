"""Where sources and crests of teams are found. The addresses and the sources' own names of teams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_tokens

TEAMS = [
    "alaves", "athletic-bilbao", "atletico-madrid", "barcelona", "real-betis", "celta-vigo", "deportivo-la-coruna", "elche", "espanyol", "getafe", "levante", "malaga", "osasuna",
    "racing-santander", "rayo-vallecano", "real-madrid", "real-sociedad", "sevilla", "valencia", "villarreal",
]
#: By source: the address before a team's name, what the source calls teams where it is not their own name.
SOURCES = {
    "futbolfantasy": ("https://www.futbolfantasy.com/laliga/equipos/", {
        "athletic-bilbao": "athletic", "atletico-madrid": "atletico", "real-betis": "betis", "celta-vigo": "celta", "deportivo-la-coruna": "deportivo", "racing-santander": "racing", "rayo-vallecano": "rayo",
    }),
    "jornadaperfecta": ("https://www.jornadaperfecta.com/equipo/", {
        "athletic-bilbao": "athletic", "atletico-madrid": "atletico", "real-betis": "betis", "celta-vigo": "celta", "deportivo-la-coruna": "deportivo", "racing-santander": "racing",
    }),
    "comuniate": ("https://www.comuniate.com/equipos/", {
        "alaves": "89/alaves-alineacion", "athletic-bilbao": "1/athletic-club-alineacion", "atletico-madrid": "2/atletico-alineacion", "barcelona": "3/barcelona-alineacion",
        "real-betis": "4/betis-alineacion", "celta-vigo": "5/celta-alineacion", "deportivo-la-coruna": "6/deportivo-alineacion", "elche": "75/elche-alineacion", "espanyol": "7/espanyol-alineacion",
        "getafe": "8/getafe-alineacion", "levante": "10/levante-alineacion", "malaga": "65/malaga-alineacion", "osasuna": "12/osasuna-alineacion", "racing-santander": "14/racing-alineacion",
        "rayo-vallecano": "70/rayo-vallecano-alineacion", "real-madrid": "15/real-madrid-alineacion", "real-sociedad": "13/real-sociedad-alineacion", "sevilla": "17/sevilla-alineacion",
        "valencia": "18/valencia-alineacion", "villarreal": "19/villarreal-alineacion",
    }),
    "analiticafantasy": ("https://www.analiticafantasy.com/equipo/", {
        "alaves": "alaves-542", "athletic-bilbao": "athletic-club-531", "atletico-madrid": "atletico-madrid-530", "barcelona": "barcelona-529", "real-betis": "real-betis-543", "celta-vigo": "celta-vigo-538",
        "deportivo-la-coruna": "deportivo-la-coruna-544", "elche": "elche-797", "espanyol": "espanyol-540", "getafe": "getafe-546", "levante": "levante-539", "malaga": "malaga-535", "osasuna": "osasuna-727",
        "racing-santander": "racing-santander-4665", "rayo-vallecano": "rayo-vallecano-728", "real-madrid": "real-madrid-541", "real-sociedad": "real-sociedad-548", "sevilla": "sevilla-536",
        "valencia": "valencia-532", "villarreal": "villarreal-533",
    }),
}
CRESTS, CREST_NUMBERS = "https://crests.football-data.org/", {
    "alaves": 263, "athletic-bilbao": 77, "atletico-madrid": 78, "barcelona": 81, "real-betis": 90, "celta-vigo": 558, "elche": 285, "espanyol": 80, "getafe": 82, "levante": 88, "malaga": 84,
    "osasuna": 79, "rayo-vallecano": 87, "real-madrid": 86, "real-sociedad": 92, "sevilla": 559, "valencia": 95, "villarreal": 94,
}
OTHER_CRESTS = {
    "deportivo-la-coruna": "https://encrypted-tbn0.gstatic.com/images?q=tbn:ANd9GcQZh5Fh0XtzUfdYgfiSGWlL6tLZqy5qg6jG-KffVAa7tA&s=10",
    "racing-santander": "https://comprarpegatinas.com/images/stories/virtuemart/product/pegatinas/Racing_Santander.png",
}


def _of(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def source_url(source: Column, team: Column) -> Column:
    """The address of a team's page at a source; null for a source or a team that isn't known."""
    every = {name: {t: base + names.get(t, t) for t in TEAMS} for name, (base, names) in SOURCES.items()}
    return F.coalesce(*(F.when(source == name, _of(urls, team)) for name, urls in every.items()))


def crest(own: Column, team: Column) -> Column:
    """A team's own crest, else the one that is known for it, else null."""
    return F.coalesce(own, _of({t: f"{CRESTS}{n}.svg" for t, n in CREST_NUMBERS.items()} | OTHER_CRESTS, team))


def encyclopaedia(name: Column, title: Column) -> tuple[Column, Column]:
    """(url, source) of a player: the article that a search found, if its title has a word of three letters or more of the
    name, else a search at a market site. A null title is a search without an answer."""
    long = lambda c: F.filter(all_tokens(F.coalesce(c, F.lit(""))), lambda t: F.length(t) > 2)
    fits = F.coalesce((title != "") & F.arrays_overlap(long(name), long(title)), F.lit(False))
    plain = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    article = F.concat(F.lit("https://es.wikipedia.org/wiki/"), plain(F.replace(title, F.lit(" "), F.lit("_"))))
    search = F.concat(F.lit("https://www.transfermarkt.es/schnellsuche/ergebnis/schnellsuche?query="), plain(name))
    return F.when(fits, article).otherwise(search), F.when(fits, "Wikipedia search result").otherwise("Transfermarkt search")
