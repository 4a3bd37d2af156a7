"""Schemas: grids in cell and packed form, the cube's catalog, paths, and what readers return."""

from __future__ import annotations

LEVEL = "struct<type:string,ord:int,hpa1:int,hpa2:int>"
PARAM = "struct<type:string,code:int,unit:string>"
VALID = "struct<type:string,start:timestamp,finish:timestamp>"
AREA = "struct<top:double,bottom:double,left:double,right:double>"
CELLS = "surface_id string, x int, y int, value double"
PACKED = "surface_id string, nx int, ny int, buf array<double>"
CATALOG = f"surface_id string, param {PARAM}, level {LEVEL}, valid {VALID}, area {AREA}"
VERTICES = "path_id int, ring int, seq int, cmd string, x double, y double"
AFFINE = "struct<sx:double,shy:double,shx:double,sy:double,tx:double,ty:double>"
GTS_BULLETIN = "path string, frame_no int, frame_off long, frame_type string, ttaaii string, cccc string, yygggg string, bbb string, body binary"
GRIB_MESSAGE = "path string, frame_no int, grib_no int, ttaaii string, cccc string, yygggg string, bbb string, message binary"
PARSE_EVENT = "doc_id long, seq int, id int, start int, finish int"
SHAPE_ATTR = "id int, name string, attr struct<i:int,d:double,s:string>"

#: Order of level types.
LEVEL_ORDER = {"tropopause": 1, "max_wind": 2, "isobaric": 3, "surface": 4, "isobaric_range": 5}
