"""Pages of eight sources through the shared template. Each shape is a row of
knobs, a page, and the events that it holds, told by hand; the query lays each
page of the driver's table, whole, after a shape's, so that its text is read too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import template as A
from almanac.plans.agenda import query
from almanac.plans.records import pick
from almanac.session import read

#: knobs, last part of the address, html, and (titulo, day, hora, lugar, names, tipo, score).
SHAPES = [
    (
        {"municipio": "Villa Alta", "articulo": True, "etiqueta": "noticia"},
        "2026/programa-de-san-juan",
        '<nav>Menú</nav><h1 class="post-title">Programa de San Juan. JUNIO 2026</h1><p>Viernes 26</p><p>20:00 h – Plaza Mayor<br>Misa</p><p>21.30h Gran verbena con la Orquesta Olimpia y Grupo Pati</p><p>Sábado 27</p><p>23:00 Baile de magos en el Recinto Ferial</p><div class="share-post">',
        [("Gran verbena con la Orquesta Olimpia y Grupo Pati", "26-06-2026", "21:30", "Plaza Mayor", "Olimpia,Pati", "Baile Normal", 5), ("Baile de magos en el Recinto Ferial", "27-06-2026", "23:00", "Recinto Ferial", "", "Baile Magos", 5)],
    ),
    (
        {"municipio": "Villa Baja", "regla_anyo": "publicado", "regla_mes": "turno", "turno": 20, "mes_antes": "07", "mes_despues": "08"},
        "fiestas",
        '<meta property="article:published_time" content="2026-07-01"><p>Sábado 25: Gran verbena popular. Domingo 2: gran baile a las 22:00 en la Plaza del Charco</p>',
        [("Gran verbena popular", "25-07-2026", "", "Villa Baja", "", "Baile Normal", 5), ("gran baile a las 22:00 en la Plaza del Charco", "02-08-2026", "22:00", "Plaza del Charco", "", "Baile Normal", 8)],
    ),
    (
        {"municipio": "Puerto", "regla_anyo": "fijo", "anyo_fijo": "2026", "partir": "lugar"},
        "programa.pdf",
        "<p>• Plaza Vieja. Viernes 4 de septiembre 22:00 Verbena popular con Orquesta Sur.</p><p>• Casa Nueva. Sábado 5 de septiembre 21:00 fuegos. 23:30 tardeo y verbena.</p>",
        [("Verbena popular con Orquesta Sur", "04-09-2026", "22:00", "Plaza Vieja", "Sur", "Baile Normal", 8), ("tardeo y verbena", "05-09-2026", "23:30", "Casa Nueva", "", "Baile Normal", 4)],
    ),
    (
        {"municipio": "Sur", "partir": "ficha"},
        "2026/baile-del-sur",
        "<h1>Gran baile, 25 y 26 de abril y 1 de mayo</h1><p>A las 9:30 pm con Orquesta Norte</p><p>Lugar: Casa de la Cultura.</p>",
        [("Gran baile, 25 y 26 de abril y 1 de mayo", d, "21:30", "Casa de la Cultura", "", "Baile Normal", 7) for d in ("25-04-2026", "26-04-2026", "01-05-2026")],
    ),
    (
        {"municipio": "Costa", "regla_anyo": "fijo", "anyo_fijo": "2026", "patron_extra": "noche de kioscos", "puntos_extra": 1, "nucleos": ["El Médano"], "cascada": ["nucleo", "defecto"]},
        "kioscos",
        "<p>Martes 7 de julio de 2026 en El Medano</p><p>Noche de kioscos con la Orquesta Mar</p><p>Jueves 9</p><p>Verbena popular de todos</p><p>Viernes 10</p><p>Verbena con Parranda Sol</p>",
        [("Noche de kioscos con la Orquesta Mar", "07-07-2026", "", "El Médano", "Mar", "Otro", 7), ("Verbena popular de todos", "09-07-2026", "", "Costa", "", "Baile Normal", 5)],
    ),
    (
        {"municipio": "Vega", "regla_anyo": "fijo", "anyo_fijo": "2027", "cascada": ["continuacion", "titulo", "defecto"]},
        "vega",
        "<p>Lunes 1 de marzo 23:00 Gran verbena con Grupo Luna</p><p>Plaza del Sol</p><p>Martes 2 de marzo 22:00 Verbena en la Plaza Chica</p>",
        [("Gran verbena con Grupo Luna", "01-03-2027", "23:00", "Plaza del Sol", "Luna", "Baile Normal", 5), ("Verbena en la Plaza Chica", "02-03-2027", "22:00", "Plaza Chica", "", "Baile Normal", 5)],
    ),
    (
        {"municipio": "Monte", "regla_anyo": "ruta"},
        "2019/viejo",
        "<p>Lunes 1 de marzo 23:00 Gran verbena con Grupo Luna</p>",
        [],
    ),
    (
        {"municipio": "Valle", "regla_mes": "seccion"},
        "2026/valle",
        "<p>Lunes 3: Gran verbena popular</p><p>Inscripción hasta el 4 de mayo</p><p>5 de mayo: la verbena fue un éxito</p><p>6 de mayo: taller de baile</p>",
        [("Gran verbena popular", "03-05-2026", "", "Valle", "", "Baile Normal", 5)],
    ),
]


def table(spark):
    return A.knobs(spark, [{"fuente": f"f{i}", **k} for i, (k, *_) in enumerate(SHAPES)])


_ROWS = ", ".join(f"({i}, '{t}', '{d}', '{h}', '{p}', '{n}', '{k}', {s})" for i, (*_, rows) in enumerate(SHAPES) for t, d, h, p, n, k, s in rows)


#: Each shape's folder, which may tell the year, and the last part of its address.
_PATHS = [("x/" + u).rpartition("/")[::2] for _, u, *_ in SHAPES]
_FOLDERS, _LASTS = ([p[i] for p in _PATHS] for i in (0, 1))


@query(f"SELECT 'https://s.es/' || ['{"','".join(_FOLDERS)}'][page_id % {len(SHAPES)} + 1] || '/' || page_id || '-' || ['{"','".join(_LASTS)}'][page_id % {len(SHAPES)} + 1] AS url, titulo, day, hora, lugar, nombres, tipo, score FROM pages JOIN (VALUES {_ROWS}) v(forma, titulo, day, hora, lugar, nombres, tipo, score) ON page_id % {len(SHAPES)} = forma")
def template_events(spark, sf):
    k = F.col("page_id") % len(SHAPES)
    around = F.regexp_replace("html", "(?is)<h1", "<h2")
    told = pick([x[2] for x in SHAPES], k)
    html = F.concat(told, F.lit("<hr><p>.</p>"), around)  # the page goes on with the driver's
    url = F.concat(F.lit("https://s.es/"), pick(_FOLDERS, k), F.lit("/"), F.col("page_id").cast("string"), F.lit("-"), pick(_LASTS, k))
    pages = read(spark, sf, "pages").select(F.concat(F.lit("f"), k.cast("string")).alias("fuente"), url.alias("url"), html.alias("html"))
    found = A.events(pages, table(spark))
    return found.select("url", "titulo", "day", "hora", "lugar", F.array_join("orquestas", ",").alias("nombres"), "tipo", "score")
