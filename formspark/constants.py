"""Fixed values of the business domain (Spanish-language insurance forms).

Everything in this module is a fixed value: word lists, lookup tables, patterns and
weights whose content decides the results. They are data; no logic lives here.
"""

# Column roles of a field matrix and the header texts that name them.
MATRIX_ROLES = {
    "form_code": ["código formulario", "codigo formulario", "código pdf", "codigo pdf", "form code", "pdf id",
                  "id formulario", "formulario id"],
    "step": ["pasos formulario", "paso", "pasos"],
    "section": ["sección", "seccion"],
    "pdf_label": ["nombre en pdf"],
    "field_label": ["nombre del campo en formulario", "campo en formulario"],
    "data_type": ["tipo de dato", "tipo dato"],
    "value": ["valor"],
    "rule": ["regla"],
    "required": ["obligatorio"],
    "product_scope": ["formulario a visualizar"],
    "visualization": ["visualización en formularios", "visualizacion en formularios"],
    "obs": ["observaciones"],
    "json_name": ["nombre del campo en json", "campo en json"],
    "pdf_field_name": ["nombre del campo en pdf", "campo en pdf"],
}
# Positions used when no header row is recognised.
MATRIX_FALLBACK = ["step", "section", "pdf_label", "field_label", "data_type", "value", "rule", "required",
                   "product_scope", "visualization", "obs", "json_name", "pdf_field_name"]
# Header texts of a catalog sheet.
CATALOG_CODE_HEADERS = ["codigo", "código", "code", "cod", "id", "clave"]
CATALOG_LABEL_HEADERS = ["descripcion", "descripción", "nombre", "label", "name", "valor"]

# The 22 positional columns of a mapping sheet.
MAPPING_COLUMNS = ["row_num", "section_pdf", "acro_actual", "acro_proposed", "label", "source_name", "native_type",
                   "group_name", "page", "path_main", "paths_secondary", "prefilled", "required", "max_length",
                   "pattern", "format", "visibility", "catalog_name", "options_raw", "data_type", "rule",
                   "catalog_sheet"]

# The 14 positional columns of a ficha sheet.
FICHA_COLUMNS = ["step", "section", "pdf_label", "label", "data_type", "value", "rule", "required", "forms",
                 "visualization", "obs", "json_section", "route", "source_name"]
FICHA_INDEX_SHEET = "Estructura base JSON"
FICHA_SAMPLE_SHEET = "JSON Generado"
FICHA_EMPTY_MARKS = ["NO APLICA PARA ESTE FORMULARIO", "NO POSEE CAMPOS PROPIOS"]
FICHA_TYPES = {
    "TEXTO": "text", "NUMERICO": "number", "NUMERICO/PORCENTUAL": "number", "FECHA": "date", "COMBO": "select",
    "RADIO/COMBO": "radio", "BOOLEAN": "boolean", "CHECKBOX": "checkbox", "CHECK BOX": "checkbox", "TABLA": "tabla",
    "COMENTARIO INFORMATIVO": "label",
}

# Ordered patterns that turn a data type text into a field type.
TYPE_PATTERNS = [
    ("titulo|heading", "heading"),
    ("comentario informativo|informativo|info", "readonly"),
    ("radio", "radio"),
    ("combo|select|lista", "select"),
    ("fecha|date", "date"),
    ("numeric|numero|number", "number"),
    ("checkbox|check", "checkbox"),
    ("alfanum", "text"),
    ("texto|text|string", "text"),
]
CHOICE_TYPES = "combo|radio|select|lista"

# Exact data type names, per table that is used.
TYPE_NAMES = {
    "texto": "text", "text": "text", "alfanumerico": "text", "numerico": "number", "number": "number",
    "fecha": "date", "date": "date", "combo": "select", "select": "select", "lista": "select",
    "radio/combo": "radio", "radio": "radio", "checkbox": "checkbox", "check": "checkbox",
    "comentario informativo": "readonly", "informativo": "readonly", "titulo": "heading", "heading": "heading",
}
MAPPING_TYPE_NAMES = {
    "texto": "text", "alfanumerico": "text", "alfanumérico": "text", "numerico": "number", "numérico": "number",
    "fecha": "date", "combo": "select", "lista": "select", "select": "select", "dropdown": "select",
    "radio": "radio", "radio/combo": "radio", "checkbox": "checkbox", "check": "checkbox",
    "comentario informativo": "readonly", "informativo": "readonly", "titulo": "heading", "textarea": "textarea",
}
NATIVE_TYPES = {"Tx": "text", "Btn": "checkbox", "Ch": "select", "Sig": "signature"}

# Regular expressions a rule text turns into.
PATTERN_DATE_SLASH = r"^\d{2}/\d{2}/\d{4}$"
PATTERN_DATE_DASH = r"^\d{2}-\d{2}-\d{4}$"
PATTERN_DIGITS = r"^\d+$"
PATTERN_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PATTERN_ALNUM = "^[A-Za-z0-9 ]+$"

# Format names and number formats.
FORMATS = {
    "fecha": "fecha", "email": "email", "correo": "email", "numerico": "numérico", "numericoporcentual": "numérico",
    "alfanumerico": "alfanumérico", "texto": "alfanumérico",
}
NUMBER_FORMATS = {"monto": "#.##0,00", "entero": "#.##0", "porcentaje": "00.00"}

# Words and limits used when proposing names.
MAX_SLUG = 30
SLUG_STOP_WORDS = ["y", "de", "del", "la", "el", "los", "las", "en", "con", "que", "se", "por", "para", "una", "un",
                   "al", "su", "u", "o", "completo", "completa"]
FILE_NOISE_WORDS = ["ficha", "configuracion", "matriz", "reglas", "formulario", "solicitud", "de", "del", "la", "el"]
AMBIGUOUS_NAMES = ["dia", "mes", "ano", "otro", "si", "no", "desde", "hasta"]
NOISE_CONNECTORS = "_(y|de|del|la|el|que|con|en|los|las|para|una|un|se|por)_"
NOISE_PHRASES = ["exprese_claramente", "nombre_completo_y_el_cargo", "desempena_dentro", "persona_juridica",
                 "datos_personales", "declaro_que", "acepto_que", "autorizo_a"]
SOURCE_NOISE_PHRASES = ["exprese_claramente", "al_momento", "en_caso_de", "declaro_que", "firma_del",
                        "nombre_completo_y_el_cargo", "el_cargo", "autorizo_a", "acepto_las", "por_este_medio"]
DIRTY_VALUES = ["undefined", "undefine", "NOTIFICACIONES", "null", "NaN"]

# Products a row may be meant for.
PRODUCT_KEYWORDS = {
    "1009052": ["vida colectiva", "colectiva"],
    "D0306": ["vida universal", "universal"],
    "D0309": ["proteccion crediticia", "protección crediticia", "crediticia"],
}

# Index of the person block a section writes to, and blocks without one yet.
PERSON_INDEX = {"asegurado_": 0, "beneficiario_1_": 1, "beneficiario_2_": 2, "beneficiario_3_": 3}
FUTURE_SECTIONS = ["dme_", "asn_", "dependiente_", "codeudor_"]

# Path pieces that are corrected, in order.
PATH_CORRECTIONS = [
    ("datosGenerales.personas", "datosFormulario.personas"),
    ("Consentimiento", "consentimiento"),
    ("dispotabilidadCarencia", "disputabilidadCarencia"),
]

# Catalog names implied by words of a label, in order.
CATALOG_HINTS = [
    ("moneda", "Moneda"),
    (r"estado\s*civil", "Estado Civil"),
    ("parentesco", "Parentesco"),
    (r"tipo\s+formulario", "Tipo Formulario"),
    (r"tipo\s+persona", "Tipo Persona"),
    (r"tipo\s*tr[aá]mite", "TipoTramite"),
    (r"tipo\s+identificaci[oó]n", "Tipo Identificación"),
]

# How a field is prefilled, by path and by name.
MANDATORY_PATHS = ["encabezado.", "polizaMadre.", "intermediario."]
MANDATORY_INSURED_FIELDS = ["primer_apellido", "segundo_apellido", "nombre_completo", "numero_identificacion",
                            "fecha_nac_dia", "fecha_nac_mes", "fecha_nac_ano"]
MANDATORY_INSURED_GROUPS = ["tipo_identificacion", "sexo"]
MANDATORY_INSURED_PREFIXES = ["tipo_id_", "sexo_", "fecha_nac_"]
MANDATORY_PREFIXES = ["vigencia_", "tomador_", "poliza_"]

# Options of the date parts.
MONTHS = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre",
          "Noviembre", "Diciembre"]
MONTH_CODES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic"]
YEARS = (2024, 2080)

# Help shown for a field name.
HELP_TEXTS = {
    "solicitud_lugar": "Indique la ciudad o localidad donde se realiza la solicitud.",
    "solicitud_fecha_dia": "Día de la fecha de solicitud.",
    "solicitud_fecha_mes": "Mes de la fecha de solicitud.",
    "solicitud_fecha_ano": "Año de la fecha de solicitud.",
    "poliza_nombre_tomador": "Nombre completo del tomador de la póliza (persona o empresa).",
    "poliza_numero": "Número de póliza asignado por el INS.",
    "asegurado_primer_apellido": "Primer apellido del asegurado según documento de identidad.",
    "asegurado_segundo_apellido": "Segundo apellido del asegurado según documento de identidad.",
    "asegurado_nombre_completo": "Nombre(s) de pila del asegurado.",
    "asegurado_tipo_id_cedula": "Seleccione si el tipo de identificación es Cédula.",
    "asegurado_tipo_id_dimex": "Seleccione si el tipo de identificación es DIMEX.",
    "asegurado_tipo_id_didi": "Seleccione si el tipo de identificación es DIDI.",
    "asegurado_tipo_id_pasaporte": "Seleccione si el tipo de identificación es Pasaporte.",
    "asegurado_tipo_id_otro": "Seleccione si el tipo de identificación es otro no listado.",
    "asegurado_tipo_id_otro_texto": "Especifique el tipo de identificación si eligió \"Otro\".",
    "asegurado_numero_identificacion": "Número del documento de identificación.",
    "asegurado_profesion_ocupacion": "Profesión u ocupación actual del asegurado.",
    "asegurado_fecha_nac_dia": "Día de nacimiento del asegurado.",
    "asegurado_fecha_nac_mes": "Mes de nacimiento del asegurado.",
    "asegurado_fecha_nac_ano": "Año de nacimiento del asegurado.",
    "asegurado_sexo_masculino": "Seleccione si el sexo es Masculino.",
    "asegurado_sexo_femenino": "Seleccione si el sexo es Femenino.",
    "asegurado_pais": "País de residencia del asegurado.",
    "asegurado_provincia": "Provincia de residencia dentro de Costa Rica.",
    "asegurado_canton": "Cantón de residencia dentro de la provincia.",
    "asegurado_distrito": "Distrito de residencia dentro del cantón.",
    "asegurado_direccion_exacta": "Dirección física completa para correspondencia.",
    "asegurado_telefono_movil": "Número de teléfono celular del asegurado.",
    "asegurado_correo": "Correo electrónico para comunicaciones del seguro.",
    "monto_asegurado": "Monto del capital asegurado en la moneda seleccionada.",
    "vigencia_desde": "Fecha de inicio de vigencia de la póliza.",
    "vigencia_hasta": "Fecha de fin de vigencia de la póliza.",
    "medio_notificacion": "Medio preferido para recibir notificaciones del INS.",
    "tomador_nombre_cargo": "Nombre completo y cargo del representante legal o tomador.",
}
# Help of the repeated beneficiary block ({n} is its number).
BENEFICIARY_HELP = {
    "numero": "Número consecutivo del beneficiario.",
    "nombre": "Nombre completo del beneficiario {n}.",
    "tipo_id": "Tipo de identificación del beneficiario {n}.",
    "numero_id": "Número de identificación del beneficiario {n}.",
    "parentesco": "Parentesco del beneficiario {n} con el asegurado.",
    "porcentaje": "Porcentaje de participación del beneficiario {n}. La suma de todos debe ser 100%.",
}
BENEFICIARY_HELP_BLOCKS = 10

# Sample values by field name, first pattern that matches.
SAMPLE_RULES = [
    (r"_dia$|_dia_", "28"),
    (r"_mes$|_mes_", "09"),
    (r"_ano$|_anio$|_year$", "2026"),
    (r"fecha|nacimiento|constitucion|vigencia|desde|hasta", "28/09/2026"),
    (r"hora", "14:30"),
    (r"correo|email|mail", "correo.prueba@ejemplo.cr"),
    (r"telefono|celular|movil|fax", "8888-8888"),
    (r"cedula_juridica|juridica", "3-101-123456"),
    (r"identificacion|cedula|documento|_id$", "1-2345-6789"),
    (r"porcentaje|_pct", "50"),
    (r"monto|salario|sueldo|ingreso|prima|suma|valor|comision|precio", "1.250.000,00"),
    (r"edad", "35"),
    (r"peso", "72"),
    (r"estatura|altura", "1,75"),
    (r"cantidad|numero_de|cant_", "3"),
    (r"poliza|solicitud_numero|_numero$", "0123456789"),
    (r"primer_apellido", "RODRÍGUEZ"),
    (r"segundo_apellido", "JIMÉNEZ"),
    (r"primer_nombre|^.*_nombre$", "MARÍA FERNANDA"),
    (r"nombre_completo|razon_social|nombre", "MARÍA FERNANDA RODRÍGUEZ JIMÉNEZ"),
    (r"provincia", "San José"),
    (r"canton", "Escazú"),
    (r"distrito", "San Rafael"),
    (r"pais|nacionalidad", "Costa Rica"),
    (r"direccion|domicilio|senas", "Del parque central 200 metros norte, casa esquinera color blanco"),
    (r"ocupacion|profesion|puesto|actividad|negocio", "Ingeniera industrial"),
    (r"patrono|empleador|empresa|agencia", "Industrias del Valle S.A."),
    (r"parentesco|relacion", "Cónyuge"),
    (r"observacion|detalle|motivo|causa|descripcion",
     "Detalle de prueba para verificar cómo entra el texto en la caja."),
    (r"lugar", "San José, Costa Rica"),
    (r"firma", "María F. Rodríguez J."),
]
SAMPLE_DEFAULT = "Dato de prueba"
SAMPLE_LONG = "TEXTO LARGO DE PRUEBA PARA VERIFICAR HASTA DÓNDE ENTRA ANTES DE CORTARSE"

# Spelling and agreed vocabulary of visible texts.
SPELLING = {
    "Informacion": "Información", "informacion": "información", "Poliza": "Póliza", "poliza": "póliza",
    "Dolares": "Dólares", "dolares": "dólares", "Cedula": "Cédula", "cedula": "cédula", "Juridica": "Jurídica",
    "juridica": "jurídica", "Institucion": "Institución", "autonoma": "autónoma", "Emision": "Emisión",
    "Automatico": "Automático", "Deduccion": "Deducción", "Electronico": "Electrónico",
    "electronico": "electrónico", "Fisico": "Físico", "Fisica": "Física", "Telefono": "Teléfono",
    "telefono": "teléfono", "Direccion": "Dirección", "direccion": "dirección", "Canton": "Cantón",
    "Descripcion": "Descripción", "Codigo": "Código", "codigo": "código", "Identificacion": "Identificación",
    "identificacion": "identificación", "Autorizacion": "Autorización", "Notificacion": "Notificación",
    "notificacion": "notificación", "Numero": "Número", "Ano": "Año", "Dia": "Día", "tramite": "trámite",
    "Tramite": "Trámite", "Ubicacion": "Ubicación", "razon": "razón",
}
TERMS = {"Genero": "Sexo", "Género": "Sexo", "genero": "sexo", "género": "sexo"}

# Person codes that belong together, and their aliases.
PERSON_ALIASES = {"JRD": "PJR"}
PERSON_GROUPS = {"asegurado": ["ASG", "DME", "DMA"], "tomador": ["TOM"], "juridica": ["PJR"]}
SECTION_ORDER = ["Datos Generales", "Datos de la Persona", "Dependientes", "Información del Riesgo", "Beneficiarios",
                 "Firmas", "Declaraciones y Autorización"]

# Headings recognised on a page, in order.
HEADINGS = [
    (["lugar y fecha de solicitud"], "solicitud_", "Lugar y Fecha de Solicitud", False),
    (["datos de la poliza", "poliza"], "poliza_", "Datos de la Póliza", False),
    (["datos del solicitante", "datos del asegurado", "asegurado", "solicitante"], "asegurado_",
     "Datos del Solicitante", False),
    (["datos del objeto de interes", "objeto de interes"], "", "Datos del Objeto de Interés", False),
    (["beneficiario", "beneficiarios"], "beneficiario_", "Beneficiarios", True),
    (["plazo de vigencia", "vigencia"], "vigencia_", "Plazo de Vigencia", False),
    (["notificaciones", "notificacion"], "notificacion_", "Notificaciones", False),
    (["firma", "tomador"], "tomador_", "Firma / Tomador", False),
]
SUBHEADINGS = [
    (["tipo de identificacion", "tipo identificacion"], "tipo_id_", "tipo_identificacion"),
    (["sexo"], "sexo_", "sexo"),
    (["en calidad de"], "calidad_", "calidad"),
]
GROUP_LABELS = {
    "fecha_solicitud": "Solicitud", "fecha_nacimiento": "Nacimiento", "vigencia_desde": "Vigencia Desde",
    "vigencia_hasta": "Vigencia Hasta", "tipo_identificacion": "Tipo Identificación", "sexo": "Sexo",
    "calidad": "Calidad",
}

# Settings of the name grouping.
OPTION_SUFFIXES = ["NoAplica", "Si", "No"]
LOOKUP_PREFIXES = {"enf": ("Catálogo Enfermedades", "Cuestionario de Salud", "enfermedades")}
SECTION_BY_PREFIX = {
    "titular": "Datos del Titular", "tomador": "Datos del Tomador", "dep": "Dependientes", "depTit": "Dependientes",
    "benef": "Beneficiarios", "benefDep": "Beneficiarios", "cuest": "Cuestionario",
    "riesgo": "Cuestionario de Salud", "intermediario": "Datos del Asesor", "pago": "Forma de Pago",
    "vigencia": "Vigencia", "moneda": "Datos de la Póliza", "plan": "Plan / Coberturas", "firma": "Firmas",
    "decl": "Declaraciones", "jurada": "Declaración Jurada",
}
DEFAULT_SECTION = "General"
ENTITY_PREFIXES = ["benefDep", "depTit", "benef", "dep"]

# Section template and the words that lead to each part, in order.
SECTION_TEMPLATE = [
    ("Datos Generales", [("sistema", "Datos del Sistema (oculto)"), ("solicitud", "Información de la Solicitud"),
                         ("asesor", "Datos del Asesor"), ("notificacion", "Preferencias de Notificación")]),
    ("Datos del Tomador", [("tomador", "Datos del Tomador"), ("contacto", "Contacto y Ubicación")]),
    ("Datos del Grupo a Asegurar", [("grupo", "Tipo del Grupo · Suma a Asegurar · Cantidad de Miembros")]),
    ("Coberturas del Seguro", [("basicas", "Coberturas Básicas"), ("adicionales", "Coberturas Adicionales")]),
    ("Condiciones Generales Modificables", [("condiciones", "Condiciones Generales Modificables")]),
    ("Declaraciones Legales", [("declaraciones", "Declaraciones"), ("aceptacion", "Aceptación y consentimiento")]),
]
SECTION_KEYWORDS = {
    "sistema": ["sistema", "oculto", "hidden", "internal"],
    "solicitud": ["solicitud", "información de la solicitud", "info solicitud"],
    "asesor": ["asesor", "agente", "intermediario", "corredor"],
    "notificacion": ["notificación", "notificacion", "preferencia"],
    "tomador": ["tomador", "contratante", "titular"],
    "contacto": ["contacto", "ubicación", "ubicacion", "dirección", "direccion", "domicilio"],
    "grupo": ["grupo", "asegurar", "suma", "miembro", "cantidad"],
    "basicas": ["básica", "basica", "cobertura básica", "coberturas basicas"],
    "adicionales": ["adicional", "cobertura adicional"],
    "condiciones": ["condición", "condicion", "modificable"],
    "declaraciones": ["declaración", "declaracion", "legal"],
    "aceptacion": ["aceptación", "aceptacion", "consentimiento", "firma"],
}

# Column kinds of a rule sheet (first pattern that matches the header) and
# the texts that tell what a cell is. A word border before "si"/"cuando" is ASCII.
RULE_COLUMNS = [
    ("regla", r"(?i)^regla|regla\s+original|regla\s+de\s+negocio|validaci[oó]n"),
    ("visualizacion", r"(?i)visualizaci[oó]n|visibilidad|condici[oó]n|mostrar\s+si|depende"),
    ("obligatorio", r"(?i)obligatorio|requerido"),
    ("valor", r"(?i)^valor|valores|opciones"),
    ("formato", r"(?i)formato|m[aá]scara|patr[oó]n"),
    ("observaciones", r"(?i)observacion"),
]
FIELD_COLUMN = r"(?i)nombre.*campo|campo.*formulario|etiqueta|nombre\s+en\s+pdf|sourcename|acroform"
CATALOG_SHEET = r"(?i)cat[aá]logo|catalogo|lista|tabla|valores|dominio"
IGNORED_SHEET = (r"(?i)json\s*generado|generado|output|resultado|instructivo|portada|[ií]ndice|estructura\s+base"
                 r"|readme|ejemplo")
CONDITION_TEXT = (r"(?i)(?<![a-z0-9_])si\s|(?<![a-z0-9_])si:|(?<![a-z0-9_])cuando(?![a-z0-9_])|depende|seg[uú]n"
                  r"|solo\s+(si|cuando|para)|en\s+caso\s+de|aplica\s+si|visible\s+si|mostrar\s+si|oculta?r?\s+si"
                  r"|>=|<=|=\s*['\"]?s[ií]")
YES_TEXT = r"(?i)^(s[ií]|si|yes|true|x|obligatorio)$"
CATALOG_REFERENCE = r"(?i)ver\s+cat[aá]logo|cat[aá]logo\s+adjunto|ver\s+lista"

# Weights and cuts of the effort score.
SCORE_WEIGHTS = {"pdf_field": 1.0, "pdf_page": 2.0, "business_rule": 2.5, "conditional_rule": 6.0, "repeater": 10.0,
                 "catalog_item": 0.2, "catalog": 5.0, "extra_form": 40.0}
SCORE_THRESHOLDS = {"baja": 900.0, "media": 1800.0}
SCORE_WEEKS = {"baja": 1, "media": 2, "alta": 3}
HOURS_PER_POINT = 0.035
REUSE_FACTOR = 0.15

# Section a path belongs to, by its first segment.
SECTION_BY_SEGMENT = {
    "datosgenerales": "LUGAR Y FECHA DE SOLICITUD", "datostomador": "DATOS DEL TOMADOR",
    "datospoliza": "DATOS DE LA PÓLIZA", "datosasegurado": "DATOS DEL SOLICITANTE",
    "datossolicitante": "DATOS DEL SOLICITANTE", "datosobjetointeres": "DATOS DEL OBJETO DE INTERÉS",
    "datosbeneficiarios": "BENEFICIARIOS", "datosvigencia": "PLAZO DE VIGENCIA",
    "datosnotificacion": "NOTIFICACIONES", "datosnotificaciones": "NOTIFICACIONES", "datosfirma": "FIRMA",
}

# Catalog a group or a label stands for, in order.
GROUP_CATALOGS = {
    "tipo_identificacion": "tipo identificación", "parentesco": "parentesco", "estado_civil": "estado civil",
    "moneda": "moneda", "tipo_persona": "tipo persona", "tipo_tramite": "tipotramite",
    "tipo_formulario": "tipo formulario", "nacionalidad": "nacionalidad",
}
LABEL_CATALOGS = [
    (r"(?i)tipo\s+(de\s+)?identificaci", "tipo identificación"),
    ("(?i)parentesco", "parentesco"),
    (r"(?i)estado\s+civil", "estado civil"),
    ("(?i)nacionalidad", "nacionalidad"),
    ("(?i)moneda", "moneda"),
    (r"(?i)tipo\s+(de\s+)?persona", "tipo persona"),
    (r"(?i)tipo\s+(de\s+)?tr[aá]mite", "tipotramite"),
    (r"(?i)tipo\s+(de\s+)?formulario", "tipo formulario"),
]
SYNTHETIC_CATALOGS = {"sexo": ("Sexo (sintético)", [("M", "Masculino"), ("F", "Femenino")])}

# Header patterns of the descriptive matrix layout, in order.
FLEX_HEADERS = [
    ("steps", "(?i)pasos"), ("section", "(?i)^secci[oó]n$"), ("pdf_label", r"(?i)nombre\s+en\s+pdf"),
    ("label", r"(?i)nombre\s+del\s+campo\s+en\s+formulario"), ("data_type", r"(?i)tipo\s+de\s+dato"), ("value", "(?i)^valor$"),
    ("rule", "(?i)^regla$"), ("required", "(?i)obligatori"), ("product_scope", r"(?i)formulario\s+a\s+visual"),
    ("visualization", "(?i)visualizaci[oó]n"), ("obs", "(?i)observacion"), ("json_section", "(?i)nombre.*secci[oó]n.*json"),
    ("json_name", "(?i)nombre.*campo.*json"), ("pdf_field_name", "(?i)nombre.*campo.*pdf$"),
]
# Header patterns of the source name column, by preference.
SOURCE_HEADERS = [r"(?i)nombre\s+interno", "(?i)sourcename", r"(?i)source\s*name", r"(?i)acroform\s+propuesto",
                  r"(?i)nombre\s+del\s+campo\s+en\s+el\s+pdf", r"(?i)nombre\s+del\s+campo\s+en\s+pdf", "(?i)propuesto",
                  "(?i)acroform"]

# The hidden header section every built form starts with.
NEVER_VISIBLE = '{"logic":"and","conditions":[{"fieldId":"field_NEVER_EXISTS","operator":"not_empty"}]}'
HEADER_SECTION = ("section_encabezado", "Encabezado (oculto)")
HEADER_FIELDS = [
    ("codigoTipoFormulario", "Tipo de Formulario", "select"),
    ("descripcionTipoFormulario", "Descripción Tipo Formulario", "text"),
    ("codigoTipoTramite", "Tipo de Trámite", "select"),
    ("descripcionTipoTramite", "Descripción Tipo Trámite", "text"),
    ("identificadorTransaccionInterno", "Identificador de Transacción", "text"),
    ("correoElectronico", "Correo Electrónico", "text"),
    ("codigoProducto", "Código de Producto", "text"),
    ("descripcionProducto", "Descripción del Producto", "text"),
    ("nombreCompletoCliente", "Nombre Completo del Cliente", "text"),
    ("identificadorArchivo", "Identificador de Archivo", "text"),
]

# Repeated blocks of an entity.
ENTITY_REPEATERS = {
    "dep": ("Dependiente", "Dependientes", 5, "datosFormulario.personas"),
    "benef": ("Beneficiario", "Beneficiarios", 4, "datosFormulario.beneficiarios"),
}

# Fixed value: levels of nested sections that a form definition is read to.
SECTION_LEVELS = 13

# Groups and labels of fields that should have a catalog.
CATALOG_GROUPS = ["tipo_identificacion", "sexo"]
CATALOG_LABELS = r"parentesco|tipo\s+(de\s+)?identificaci|estado\s+civil|nacionalidad|moneda|tipo\s+(de\s+)?persona"
