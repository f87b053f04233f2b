"""Cover anchors: the flavors of each category's cover page, as tables and as texts to match."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

#: The anchors that several categories share.
SHARED = ("nombre de la charla", "obra", "relator", "cargo relator", "hora de inicio", "hora de termino", "tiempo duracion charla", "tipologia de charla", "charla de induccion", "charla re instruccion", "reunion de coordinacion", "difusion de documentos")


@dataclass(frozen=True)
class Flavor:
    sigla: str
    name: str
    anchors: tuple[str, ...]
    anti: tuple[str, ...] = ()
    least: int = 3


#: categories' flavors in the order in which they are tried, anchors as on the page.
FLAVORS = (
    Flavor("art", "f_art_01", ("nombre del supervisor", "area de trabajo", "descripcion del trabajo a realizar", "hora de inicio de los trabajos", "n de trabajadores involucrados", "pagina 1 de")),
    Flavor("irl", "f_crs_odi_01", ("antecedentes generales", "fecha de realizacion", "tiempo de duracion", "horario de inicio", "horario de termino", "obra", "tipo de induccion", "identificacion del trabajador", "identificacion del relator", "persona trabajadora nueva", "con ausencia prolongada", "reubicada con nuevo cargo", "por nuevo proceso productivo", "pagina 1 de")),
    Flavor("odi", "f_crs_odi_03", ("nombre completo", "n telefonico", "c identidad", "empresa", "actividad", "peligro incidente potencial", "medidas de control", "pagina 1 de")),
    Flavor("charla", "f_crs_rch_01", SHARED),
    Flavor("bodega", "f_pets_07_03", ("chequeo bodega suspel respel", "f pets crs 07 03", "obra", "realizado por", "bodega suspel", "bodega respel")),
    Flavor("chps", "f_ar_01", ("acta de reunion", "f crs ar 01", "lista de convocados", "desarrollo de la reunion", "hospital de", "lugar de la reunion", "pagina 1 de")),
    Flavor("chintegral", "f_rch", SHARED),
    Flavor("chintegral", "f_japa", ("registro capacitacion", "lugar", "temas tratados", "tipo charla", "capacitacion interna", "capacitacion externa", "charla integral", "reinstruccion", "procedimiento", "charla 5 minutos", "protocolo", "personal japa", "subcontrato", "sociedad de proyectos de ingenieria")),
    Flavor("chintegral", "f_previene", ("programa previene", "infancia juventud y bienestar", "lista de asistencia", "estrategia nacional de drogas", "region", "comuna", "espacio de intervencion", "numero de asistentes", "componente", "tematica")),
    Flavor("caliente", "f_lch_3x", ("chequeo trabajos en caliente", "constructora region sur spa", "f lch crs", "item", "actividad", "cumple", "esmeril angular", "pagina 1 de")),
    Flavor("exc", "f_lch_xx", ("excavaciones", "sector inspeccionado", "obra", "fecha", "cargo", "constructora region sur spa", "descripcion", "pagina 1 de")),
    Flavor("senal", "f_lch_22", ("lista de chequeo de senaletica", "zona area", "persona(s) que realiza la inspeccion", "codigo de registro pgs", "cumple", "fotografia", "inspeccion realizada por", "pagina 1 de")),
    Flavor("ext", "f_lch_xx", ("chequeo extintores", "ubicacion del extintor", "numero de serie del extintor", "fecha de vencimiento del extintor", "tipo de extintor", "pagina 1 de")),
    Flavor("maquinaria", "f_lch_xx", ("fecha ultima mantencion", "nombre operador", "rut", "marca", "pagina 1 de")),
    Flavor("herramientas_elec", "f_lch_xx", ("constructora region sur", "f crs lch", "f lch crs", "f crs crs", "item", "actividad", "cumple", "si", "no", "na", "pagina 1 de", "inspeccion realizada"), ("elementos de proteccion personal", "lch crs 02"), 4),
    Flavor("herramientas_elec", "f_titan", ("titan", "check list", "herramientas electricas", "tn sgsso rg", "sistema de gestion de seguridad y salud ocupacional")),
    Flavor("herramientas_elec", "f_reali", ("reali", "form prev 021", "lista de chequeo de herramientas", "programa de gestion en seguridad")),
    Flavor("herramientas_elec", "f_hll_17", ("reg sso hll 17", "chequeo de herramientas", "mantencion de obra", "codificacion", "estado enchufe macho")),
    Flavor("andamios", "f_lch_05", ("lista de chequeo de andamios", "constructora region sur", "f crs lch 05", "tipo andamio", "datos del andamio", "superficie de apoyo", "estructura del andamio", "plataformas de trabajo", "pagina 1 de"), ("analisis de riesgos en el trabajo", "f crs art 01")),
    Flavor("andamios", "f_ribeiro", ("ribeiro spa", "lista de verificacion andamios", "1cl 1890", "inspeccion de andamios", "centro de trabajo", "linea de negocio")),
    Flavor("dif_pts", "f_rch", SHARED),
    Flavor("dif_pts", "f_ch_crs_01", ("registro de charla", "nombre de la capacitacion", "cargo relator", "tiempo duracion charla"), ("test de comprension", "test trabajo en", "alternativa correcta", "f pets crs")),
    Flavor("dif_pts", "f_aguasan", ("aguasan", "registro de charla y capacitacion", "categoria", "charla especifica diaria", "charla operacional", "total personal entrenado", "tema tratado")),
)
#: How an anchor that says a page's number starts, and how many anchors are shown.
PAGE_ANCHORS = ("pagina 1 de", "pagina n de")
MOST_SHOWN = 3

_ACCENTED = {chr(c): p[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(p := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and p != chr(c)}
_quote = lambda x: "'" + x.replace("'", "''") + "'"


def folded(text: str, unaccented: str | None = None) -> str:
    """SQL for a text in small letters without accents, its separators and white space as single spaces.
    unaccented: the text without accents, if there is a function for it."""
    # most texts, or their scripts, have no letter to change
    plain = unaccented or f"CASE WHEN octet_length({text}) > length({text}) THEN regexp_replace(translate({text}, '{''.join(_ACCENTED)}', '{''.join(_ACCENTED.values())}'), '[̀-ͯ]', '' /*all*/) ELSE {text} END"
    return f"trim(regexp_replace(regexp_replace(lower({plain}), '[/_-]+', ' ' /*all*/), '[ \\t\\n\\r]+', ' ' /*all*/))"


def _numbered() -> list[tuple[Flavor, int]]:
    count: dict[str, int] = {}
    out = []
    for f in FLAVORS:
        out.append((f, count.get(f.sigla, 0)))
        count[f.sigla] = count.get(f.sigla, 0) + 1
    return out


def anchor_rows() -> list[tuple]:
    """sigla, flavor, ord, min_match, place, anchor, is_anti."""
    return [(f.sigla, f.name, o, f.least, i, a, x) for f, o in _numbered() for x, own in ((0, f.anchors), (1, f.anti)) for i, a in enumerate(own)]


def flavor_arrays() -> str:
    """SQL for one row per category with its flavors in order, each with its arrays of anchors."""
    texts = lambda own: "array(" + ", ".join(map(_quote, own)) + ")" if own else "CAST(array() AS ARRAY<STRING>)"
    rows: dict[str, list[str]] = {}
    for f, o in _numbered():
        rows.setdefault(f.sigla, []).append(f"named_struct('flavor', {_quote(f.name)}, 'ord', {o}, 'least', {f.least}, 'anchors', {texts(f.anchors)}, 'anti', {texts(f.anti)})")
    return " UNION ALL ".join(f"SELECT {_quote(s)} AS sigla, array({', '.join(own)}) AS flavors" for s, own in rows.items())


#: Texts of a flavor's page: how many of its anchors are legible grows with the variant; the last has its anti-anchors too.
VARIANTS = 7


def cover_rows() -> list[tuple[int, int, str, str]]:
    """k, variant, sigla, text: pages to match, with accents, capitals and separators as readers give them."""
    rows = []
    for k, (f, _) in enumerate(_numbered()):
        for v in range(VARIANTS):
            own = [a for i, a in enumerate(f.anchors) if v >= VARIANTS - 2 or i < v] + (list(f.anti) if v == VARIANTS - 1 else [])
            text = "  ".join(a.replace(" ", "-" if i % 3 == 1 else " ").replace("cion", "ción" if v % 2 else "cion") for i, a in enumerate(own))
            rows.append((k, v, f.sigla, text.upper() if v % 3 == 1 else text))
    return rows
