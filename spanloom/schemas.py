"""Schemas of a snapshot document and of the records that are derived from it."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


SIDE = "struct<path:string,state:string,coverage:string,reason:string>"
SNAPSHOT_JSON = (
    "schema string, meta struct<base_sha:string,head_sha:string,scope:string,repository:string,head_repository:string,changed_files:int,title:string,description:string,source_bytes:bigint>,"
    " fragments array<struct<path:string,side:string,text:string,start_line:int,scope:string,region:string,syntax:string>>,"
    f" file_evidence array<struct<base:{SIDE},head:{SIDE}>>,"
    " patches array<struct<path:string,origin:string,patch:string>>, warnings array<string>"
)
REFERENCE = "struct<name:string,line:int>"
SYMBOL = (
    "struct<ord:int,name:string,node_type:string,start:int,end:int,source:string,fingerprint:string,rename_fingerprint:string,doc:string,signature:string,"
    f"calls:array<{REFERENCE}>,references:array<{REFERENCE}>,assertions:array<string>,raises:array<string>,local_bindings:array<string>>"
)
IMPORT = "struct<ord:int,local:string,module:string,name:string,level:int,line:int,top_level:boolean,aliased:boolean>"
EXTRACTION = f"struct<status:string,note:string,symbols:array<{SYMBOL}>,imports:array<{IMPORT}>>"
ROW = "struct<tag:string,old:int,new:int,text:string>"
HUNK = f"struct<old_start:int,new_start:int,old_count:int,new_count:int,rows:array<{ROW}>>"
HUNKS = f"array<{HUNK}>"
