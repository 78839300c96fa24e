"""What `new Date(text).getTime()` gives for texts of many forms, time zone UTC: milliseconds, None for no date.

Recorded with node 20; the zone of the recording was UTC.
"""

CASES = [
    ('2024-01-10', 1704844800000),
    ('2024-01', 1704067200000),
    ('2024', 1704067200000),
    ('2024-01-10T05:00', 1704862800000),
    ('2024-01-10T05:00:00', 1704862800000),
    ('2024-01-10T05:00:00.123', 1704862800123),
    ('2024-01-10T05:00:00.1', 1704862800100),
    ('2024-01-10T05:00:00.123456', 1704862800123),
    ('2024-01-10T05:00:00Z', 1704862800000),
    ('2024-01-10T05:00:00+02:00', 1704855600000),
    ('2024-01-10T05:00:00-03:30', 1704875400000),
    ('2024-01-10T24:00:00', 1704931200000),
    ('2024-01-10T24:00:01', None),
    ('2024-01-10T25:00', None),
    ('2024-01-10T05:60', None),
    ('2024-01-10 05:00:00', 1704862800000),
    ('2024-01-10 05:00', 1704862800000),
    ('2024-01-10 5:00', 1704862800000),
    ('2024-02-30', 1709251200000),
    ('2024-02-31', 1709337600000),
    ('2023-02-29', 1677628800000),
    ('2024-04-31', 1714521600000),
    ('2024-13-01', None),
    ('2024-00-10', None),
    ('2024-01-32', None),
    ('2024-01-00', None),
    ('2024-1-5', 1704412800000),
    ('2024-1-05', 1704412800000),
    ('2024/01/10', 1704844800000),
    ('2024/1/5', 1704412800000),
    ('2024/02/31', 1709337600000),
    ('10/01/2024', 1727740800000),
    ('1/10/2024', 1704844800000),
    ('10-01-2024', 1727740800000),
    ('01-10-24', 1704844800000),
    ('1/2/24', 1704153600000),
    ('1/2/49', 2493158400000),
    ('1/2/50', -631065600000),
    ('1/2/99', 915235200000),
    ('1/2/100', -59011372800000),
    ('13/01/2024', None),
    ('31/12/2024', None),
    ('12/31/2024', 1735603200000),
    ('2/31/2024', 1709337600000),
    ('2/30/2023', 1677715200000),
    ('4/31/2024', 1714521600000),
    ('1/32/2024', None),
    ('1/0/2024', None),
    ('0/1/2024', None),
    ('10.01.2024', 1727740800000),
    ('10 01 2024', 1727740800000),
    ('1/10', 979084800000),
    ('12/25', 1009238400000),
    ('32/1/2024', None),
    ('49/1/2', 2493158400000),
    ('50/1/2', -631065600000),
    ('99/12/31', 946598400000),
    ('100/1/2', -59011372800000),
    ('Jan 10, 2024', 1704844800000),
    ('Jan 10 2024', 1704844800000),
    ('January 10, 2024', 1704844800000),
    ('10 Jan 2024', 1704844800000),
    ('10 January 2024', 1704844800000),
    ('10-Jan-2024', 1704844800000),
    ('10 Jan 24', 1704844800000),
    ('Jan 10', 979084800000),
    ('10 Jan', 979084800000),
    ('2024 Jan 10', 1704844800000),
    ('Jan. 10, 2024', 1704844800000),
    ('JAN 10 2024', 1704844800000),
    ('jan 10, 2024 5:00 PM', 1704906000000),
    ('Jan 10, 2024 17:00', 1704906000000),
    ('Jan 10 2024 05:00:00 GMT', 1704862800000),
    ('Wed Jan 10 2024', 1704844800000),
    ('Wed, 10 Jan 2024 05:00:00 GMT', 1704862800000),
    ('Wednesday, January 10, 2024', 1704844800000),
    ('Wed Jan 10 2024 05:00:00 GMT+0200 (Central European)', 1704855600000),
    ('Wed Jan 10 2024 05:00:00 GMT-0300', 1704873600000),
    ('10 Jan 2024 05:00:00 EST', 1704880800000),
    ('10 Jan 2024 05:00 PDT', 1704888000000),
    ('10 Jan 2024 05:00 UTC', 1704862800000),
    ('10 Jan 2024 05:00 Z', 1704862800000),
    ('10 Jan 2024 05:00 +0130', 1704857400000),
    ('10 Jan 2024 05:00 +2', 1704855600000),
    ('10 Jan 2024 05:00 +02:00', 1704855600000),
    ('Feb 31 2024', 1709337600000),
    ('Feb 30, 2023', 1677715200000),
    ('Apr 31 2024', 1714521600000),
    ('Jan 32 2024', None),
    ('Jan 0 2024', None),
    ('10/01/2024 5:00', 1727758800000),
    ('10/01/2024 05:00:00', 1727758800000),
    ('10/01/2024 05:00:00.5', 1727758800500),
    ('10/01/2024 5:00 AM', 1727758800000),
    ('10/01/2024 12:00 AM', 1727740800000),
    ('10/01/2024 12:00 PM', 1727784000000),
    ('10/01/2024 12:30 pm', 1727785800000),
    ('10/01/2024 13:00 PM', None),
    ('10/01/2024 0:30 AM', 1727742600000),
    ('10/01/2024, 5:00:00 PM', 1727802000000),
    ('10/01/2024 24:00', 1727827200000),
    ('10/01/2024 24:01', None),
    ('10/01/2024 5:60', None),
    ('10/01/2024T05:00', None),
    ('2024-01-10T5:00', None),
    ('2024-01-10t05:00:00z', 1704862800000),
    ('2024-01-10 05:00:00 GMT', 1704862800000),
    ('2024-01-10 05:00:00Z', 1704862800000),
    ('2024-01-10 05:00:00+01:00', 1704859200000),
    ('2024-01-10 05:00:00 -0500', 1704880800000),
    ('2024-01-10Z', 1704844800000),
    ('2024-01-10+02:00', None),
    ('+002024-01-10', 1704844800000),
    ('-000001-01-01', -62198755200000),
    ('+275760-09-13', 8640000000000000),
    ('+275760-09-14', None),
    ('20240110', None),
    ('2024011', None),
    ('12', 1007164800000),
    ('1', 978307200000),
    ('32', 1956528000000),
    ('49', 2493072000000),
    ('50', -631152000000),
    ('99', 915148800000),
    ('123', -58285699200000),
    ('1234567', None),
    ('0', 946684800000),
    ('basura', None),
    (' ', None),
    ('hola 2024', 1704067200000),
    ('enero 10 2024', None),
    ('10 de enero de 2024', None),
    ('2024-01-10 basura', None),
    ('Jan', None),
    ('2024-01-10T', None),
    ('T05:00', None),
    ('05:00', None),
    ('5:00 PM', None),
    ('1704844800000', None),
    ('2024-W02-3', None),
    ('2024-010', 1727740800000),
    ('10/2024', None),
    ('Jan 2024', 1704067200000),
    ('01/2024', None),
    ('2024/01', 1704067200000),
    ('2024 01 10', 1704844800000),
    ('2024.01.10', 1704844800000),
    ('(remark) Jan 10 2024', 1704844800000),
    ('Jan 10 2024 (remark)', 1704844800000),
    ('Marzo 5 2024', 1709596800000),
    ('March5 2024', 1709596800000),
    ('5March2024', 1709596800000),
    ('Mar 5,2024', 1709596800000),
    (' 2024-01-10 ', 1704844800000),
    ('2024-01-10 ', 1704844800000),
    ('Sept 5 2024', 1725494400000),
    ('Tues Jan 9 2024', 1704758400000),
    ('10/01/2024 5 PM', None),
    ('10/01/2024 5:00PM', None),
    ('Jan 10 2024 5:00pm', None),
    ('10/1/2024 05:00 GMT+2', 1727751600000),
    ('10/1/2024 05:00 GMT+02:30', 1727749800000),
    ('10/1/2024 05:00 UTC-3', 1727769600000),
    ('2024-01-10T05:00:00 +02:00', None),
    ('1/1/0024', 1704067200000),
    ('1/1/00', 946684800000),
    ('1/1/0', 946684800000),
    ('01/01/1', 978307200000),
    ('0001-01-01', -62135596800000),
    ('9999-12-31', 253402214400000),
    ('10000-01-01', 253402300800000),
    ('12/31/10000', 253433836800000),
    ('1/2/3/4', None),
    ('2024-01-10-05', None),
    ('10/01/2024 +02:00', None),
    ('foo bar Jan 10 2024', 1704844800000),
    ('Lunes 10/01/2024', 1727740800000),
    ('viernes, 5 Jan 2024', 1704412800000),
    ('2024-01-10 GMT', 1704844800000),
    ('2024-01-10 GMT+2', 1704837600000),
    ('10/01/2024 EST', 1727758800000),
    ('1/2', 978393600000),
    ('2024/13/01', None),
    ('2024/1/32', None),
    ('31/1/2024', None),
    ('31 1 2024', None),
    ('Jan 31', 980899200000),
    ('Feb 30', 983491200000),
    ('Jan 2024 10', 1704844800000),
    ('Jan10,2024', 1704844800000),
    ('10Jan2024', 1704844800000),
    ('2024Jan10', 1704844800000),
    ('1-2-3', 1041465600000),
    ('01-02-2003', 1041465600000),
    ('2003-1-2 3:04', 1041476640000),
    ('2003-1-2 3:04:05.678 PM', 1041519845678),
    ('Jan 10, 2024 EST', 1704862800000),
    ('10/01/2024 05:00:00.123456789', 1727758800123),
    ('10/01/2024 5:00 am GMT-5', 1727776800000),
    ('sábado 10/01/2024', 1727740800000),
    ('el 10/01/2024', 1727740800000),
    ('10/01/2024 basura', None),
    ('10/01/2024 5', None),
    ('2024-01-10T05:00:00.', None),
    ('2024-01-10T05', None),
    ('June 1 2001', 991353600000),
    ('Junio 1 2001', 991353600000),
    ('May 5', 989020800000),
    ('1e3', None),
    ('12.5', 1007510400000),
    ('2024--01', None),
    ('10/01/2024 5:0', 1727758800000),
    ('10/01/2024 5:00:0', 1727758800000),
    ('10/01/2024 5:00:60', None),
]
