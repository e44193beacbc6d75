"""The page layouts on small hand-written pages."""

from lineupforge.sources import adapters as A
from lineupforge.sources import pages as P


def _pages(spark, *html):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def _rows(df, *columns):
    return [tuple(r) for r in df.orderBy("page_id", "side", "ord").select(*columns).collect()]


def test_sectioned_lineup(spark):
    html = """<div id="por"><div class="jugador jugador_campo"><div class="cara_jugador"><img src="/a.png?x"></div><span class="nombre_jugador x">Ana  Gil <b class="alternativo">Eva</b></span>
    <i class="fa fa-plus"></i><span class="icono_porcentaje">80%</span></div></div><div id="def"><div class="jugador jugador_campo"><div class="nombre_jugador">Bea</div><i class="duda"></i></div></div>"""
    rows = P.sectioned_lineup(_pages(spark, html, "", None), {"por": "POR", "def": "DEF"}, "https://x.example")
    assert {tuple(r) for r in rows.select("player", "position", "probability", "photo", "doubt", "injury", "alternative").collect()} == {
        ("Ana Gil", "POR", 80, "https://x.example/a.png", False, True, "Eva"), ("Bea", "DEF", None, None, True, False, None)}
    assert {tuple(r) for r in P.flagged_events(rows).select("player", "event", "severity").collect()} == {("Ana Gil", "injury", "light"), ("Bea", "doubt", "none")}


def test_matches(spark):
    html = """<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"https://x.example/m/1","item":{"name":"A VS B"}},{"item":{"url":"https://x.example/m/2","name":"C vs. D"}},
    {"url":"https://x.example/m/1","item":{"name":"A vs B"}},{"url":"https://y.example/m/3","item":{"name":"E vs F"}}]}</script><script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"url":"https://x.example/m/4","item":{"name":"G vs H"}}]}]</script>"""
    got = P.listed_matches(_pages(spark, html, None), "https://x.example/m/").orderBy("ord").select("match", "home", "away").collect()
    assert [tuple(r) for r in got] == [("1", "A", "B"), ("2", "C", "D"), ("4", "G", "H")]


def test_linked_matches(spark):
    html = """<section class="mod proxjornada"><a class="partido" href="/partidos/7-real-sol-mar"><a href="/partidos/7-real-sol-mar"><a href="/partidos/8-luna-real-sol"><a href="/partidos/9-otro-mar"></section>
    <section class="mod proxjornada"><a href="/partidos/10-mar-luna"></section>"""
    slugs = spark.createDataFrame([("real-sol", "S"), ("real", "R"), ("sol-mar", "X"), ("mar", "M"), ("luna", "L")], "slug string, team string")
    got = P.linked_matches(_pages(spark, html, ""), slugs).orderBy("match").select("match", "home", "away").collect()
    assert [tuple(r) for r in got] == [("7", "S", "M"), ("8", "L", "S")]


def test_photo_lineup_and_medical_report(spark):
    html = """<div data-lineup-field><img alt="Foto de Ana Gil" src="https://x.example/a.png?w=1"><span class="b tabular-nums">75%</span><img src="b.png" alt="Foto de Bea"></div>
    <h3>Jugadores en Duda (1)</h3><a href="/jugadores/a"><span class="truncate">Ana Gil</span><p>knee</p><p>sore</p></a><h3>Otros</h3><a href="/jugadores/z"><span class="truncate">Zoe</span></a>
    <div data-lineup-field><img alt="Foto de Carla" src="https://x.example/c.png"></div><h3>Jugadores en Duda (1)</h3><a href="/jugadores/c"><span class="truncate">Carla</span></a>
    <h3>Jugadores Lesionados (1)</h3><a href="/jugadores/d"><span class="x truncate">Dora</span><p>leg</p></a>"""
    pages = _pages(spark, html, "<p>none</p>")
    assert _rows(P.photo_lineup(pages), "side", "player", "probability", "photo") == [("away", "Carla", 100, "https://x.example/c.png"), ("home", "Ana Gil", 75, "https://x.example/a.png"), ("home", "Bea", 100, None)]
    assert set(_rows(P.medical_report(pages), "side", "player", "event", "severity", "reason")) == {
        ("home", "Ana Gil", "doubt", "none", "knee | sore"), ("away", "Carla", "doubt", "none", None), ("home", "Dora", "injury", "light", "leg")}
    assert [r["page_id"] for r in P.quarantine(pages, P.photo_lineup(pages)).collect()] == [1]
    assert [tuple(r) for r in P.run_status(pages.withColumnRenamed("url", "source"), P.photo_lineup(pages)).collect()] == [("u", 2, 1, "partial")]


def test_sided_lineup_and_absences(spark):
    html = """<div class="campo-wrapper local"><div class="camiseta-wrapper portero" data-x="1"><a class="camiseta" data-probabilidad="90%"></a><div class="fotocontainer"><img alt="Ana" data-src="//x.example/a.png"></div></div>
    <div class="camiseta-wrapper"><a class="camiseta"></a><div class="truncate-name">Banca</div></div></div>
    <div class="campo-wrapper visitante"><div class="camiseta-wrapper"><a class="camiseta" data-probabilidad="40"></a><span class="truncate-name">Bea</span></div></div>
    <section class="mod lesionados local"><header>Lesionados del A</header><div class="elemento lesionado"><span class="jugador">Eva</span><span class="lesion">knee</span><i class="gravedad-0"></i></div></section>
    <section class="mod sancionados visitante"><header>Sancionados del B</header><div class="elemento sancionado"><span class="jugador">Flo</span><b>5 amarillas</b></div><div class="elemento sancionado"><span class="jugador">Gia</span></div></section>"""
    pages = _pages(spark, html)
    assert _rows(P.sided_lineup(pages), "side", "player", "position", "probability", "photo") == [("away", "Bea", None, 40, None), ("home", "Ana", "POR", 90, "https://x.example/a.png")]
    assert set(_rows(P.absences(pages), "side", "player", "event", "severity", "reason")) == {
        ("home", "Eva", "injury", "out", "knee"), ("away", "Flo", "suspension", "moderate", None), ("away", "Gia", "transfer", "moderate", None)}


def test_row_lineup_and_unavailable(spark):
    field = '<div class="campo-futbol lineas-4"><div class="linea-1"><a class="player"><img class="face" alt="Cara de {0}" src="https://x.example/{0}.png?1"><span class="percent-budget">{1}</span></a></div><div class="f linea-5"><a class="player"><img class="face" alt="Cara de {2}"></a></div></div>{3}'
    card = '<a class="fifa-card"><img class="face" alt="Cara de {0}"><div class="status" title="{1}"><img class="{2}"></div><span class="capitalize text">{3}</span></a>'
    html = field.format("Ana", "55%", "Bea", card.format("Eva", "knee", "lesion-x", "") + card.format("Flo", "", "x doubtful", "Duda") + card.format("Ira", "", "", "Duda")) + field.format("Carla", "", "Dora", card.format("Gia", "", "sancion", "Sancionada") + card.format("Hel", "", "", ""))
    pages = _pages(spark, html)
    assert _rows(P.row_lineup(pages), "side", "player", "position", "probability") == [("away", "Carla", "POR", 100), ("away", "Dora", "DEL", 100), ("home", "Ana", "POR", 55), ("home", "Bea", "DEL", 100)]
    assert set(_rows(P.unavailable(pages), "side", "player", "event", "severity", "reason")) == {
        ("home", "Eva", "injury", "moderate", "knee"), ("home", "Flo", "doubt", "none", "Duda"), ("home", "Ira", "injury", "light", "Duda"), ("away", "Gia", "suspension", "moderate", "Sancionada"), ("away", "Hel", "injury", "light", None)}


def test_a_repeat_ends_its_block(spark):
    item = lambda i: f'{{"url":"https://x.example/m/{i}","item":{{"name":"H{i} vs A{i}"}}}}'
    block = lambda *n: '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[' + ",".join(map(item, n)) + "]}</script>"
    got = P.listed_matches(_pages(spark, block(1, 2, 1, 3) + block(4, 3, 2, 5) + block(5), block(9, 9)), "https://x.example/m/").orderBy("page_id", "ord")
    assert [(r["page_id"], r["match"]) for r in got.collect()] == [(0, "1"), (0, "2"), (0, "4"), (0, "3"), (0, "5"), (1, "9")]


def test_sources_read_as_a_whole(spark):
    photos = """<div data-lineup-field><img alt="Foto de Ana Gil" src="a.png"><span class="b tabular-nums">75%</span></div><div data-lineup-field><img alt="Foto de Bea" src="b.png"></div>
    <h3>Jugadores en Duda (1)</h3><a href="/jugadores/a"><span class="truncate">Ana Gil</span><p>knee</p></a>"""
    again = '<div data-lineup-field><img alt="Foto de Other" src="a.png"></div><div data-lineup-field><img alt="Foto de Eva" src="b.png"></div>'
    landed = _pages(spark, photos, again, "<p>nothing</p>")
    meant = spark.createDataFrame([(0, 1, "t", "u"), (1, 2, "t", "v"), (2, 3, "w", "x")], "page_id long, place int, home string, away string")
    out = A.read_source("s", A.LAYOUTS["analiticafantasy"], landed, meant)
    assert sorted(tuple(r) for r in out["reports"].select("team", "raw", "probability", "certain").collect()) == [("t", "Ana Gil", 75.0, False), ("u", "Bea", 100.0, True), ("v", "Eva", 100.0, True)]
    assert [tuple(r)[:6] for r in out["events"].collect()] == [("s", "t", "Ana Gil", "doubt", "none", "knee")]
    assert [tuple(r) for r in out["answers"].collect()] == [("s", True, None)] and [r["page_id"] for r in out["quarantine"].collect()] == [2]
    html = """<div id="portero"><div class="jugador jugador_campo"><span class="nombre_jugador">Ana Gil</span><i class="duda"></i><b class="alternativo">Eva</b></div></div><div id="delanteros"><div class="jugador jugador_campo">
    <span class="nombre_jugador">Bea</span><span class="icono_porcentaje">40%</span><i class="fa-plus"></i></div></div>"""
    out = A.read_source("s", A.LAYOUTS["comuniate"], _pages(spark, html), meant.where("page_id = 0"))
    assert sorted(tuple(r) for r in out["reports"].select("raw", "position", "probability", "certain", "note").collect()) == [("Ana Gil", "POR", 100.0, True, "Alternativa: Eva"), ("Bea", "DEL", 40.0, False, None)]
    assert sorted(tuple(r) for r in out["events"].select("raw", "event", "severity", "note").collect()) == [("Ana Gil", "doubt", "none", "Duda de titularidad. Alternativa: Eva."), ("Bea", "injury", "light", A.HURT)]
    assert [tuple(r) for r in out["answers"].collect()] == [("s", False, None)]
    for layout in A.LAYOUTS.values():
        assert layout.players(landed.limit(0)).count() == 0 and layout.events(landed.limit(0)).count() == 0


def test_encyclopaedia_rosters(spark):
    sections = '{"parse":{"sections":[{"line":"Historia","index":"1"},{"line":"Plantilla 2025","index":"7"},{"line":"Plantel 2026","index":"8"}]}}'
    wiki = '{"parse":{"wikitext":{"*":"{{Jugador de fútbol con esquema|no=1|pos=POR|nombre=[[Unai Simón]]}} {{Jugador de fútbol con esquema|pos=DF|nombre=Ana Gil}}"}}}'
    landed = spark.createDataFrame([("a", "A", '{"query":{"redirects":[{"to":"A2"}]}}', sections, wiki), ("b", "B", None, '{"parse":{"sections":[{"line":"x","index":"1"}]}}', wiki), ("c", "C", "{}", None, None), ("d", "D", "", sections, None)], "team string, page string, redirects string, sections string, wikitext string")
    fine, failed = A.encyclopaedia_rosters(landed)
    assert sorted(map(tuple, fine.collect())) == [("a", "A2", "Plantilla 2025", "Ana Gil", "DEF"), ("a", "A2", "Plantilla 2025", "Unai Simón", "POR")]
    assert sorted(map(tuple, failed.collect())) == [("b", "B", "no section of a squad"), ("c", "C", "no answer on sections"), ("d", "D", "no answer on the text")]
