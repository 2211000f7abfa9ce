"""Schemas of the tables that operators pass on."""

OBSERVATION = "candidate_key string, field string, source string, item_ord int, value string, entry map<string,string>, raw string, confidence double, method string"
STATUS = "candidate_key string, source string, available boolean, parse_errors array<string>"
PROVENANCE = "candidate_key string, field string, source string, method string, raw_value string, normalized_value string, confidence double, notes string"
EXPERIENCE = "struct<company:string,title:string,start_date:string,end_date:string,description:string,location:string,confidence:double,source:string>"
EDUCATION = "struct<institution:string,degree:string,field_of_study:string,start_date:string,end_date:string,gpa:double,confidence:double,source:string>"
