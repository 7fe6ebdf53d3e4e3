"""Schemas of the archive engine's tables, as DDL strings."""

PARAMS = "struct<level:int,strategy:int,nowrap:boolean>"
ENTRY = f"pair_id string, path binary, path_text string, method int, crc32 long, csize long, usize long, utf8_flag boolean, local_off long, data_off long, digest string, params {PARAMS}"
RANGE = "struct<offset:long,length:long>"
PARAM_RANGE = "struct<offset:long,length:long,level:int,strategy:int,nowrap:boolean>"
PLAN = f"struct<df_old_size:long,old_ops:array<{RANGE}>,new_ops:array<{PARAM_RANGE}>,old_off:long,old_len:long,new_off:long,new_len:long,delta_len:long,delta_at:long>"
