"""The labelled table of the random field: sentences by hand, made-up values, an entity as {kind:value}."""

from __future__ import annotations

import re

TABLE = """
Please send the signed form to {email:maria.lopez@example.com} by Friday.
Reach us at {email:info@city-library.org} or {phone:+44 20 7946 0018}.
From: {email:a_b-c@mail.example.co.uk}
Bitte an {email:k.schmidt77@firma.example.de} schreiben.
Écrivez à {email:j-p.roux@exemple.fr}, merci.
Escriba a {email:ventas+2024@tienda.example.es}; gracias.
My old address was {email:dave99@example.net}, the new one is {email:dave.k@example.net}.
write to {email:helen @ example.org} if it breaks
mail me: {email:tom_w @ post.example.com}.
Reply to <{email:no-reply@shop.example.io}>
{email:x1@y2.example}
cc {email:pat@example.com},{email:lee@example.com}
Call {phone:+1 (212) 555-0147} before noon.
Call {phone:(212) 555-0147} before noon.
Tel. {phone:030 1234-5678}
Telefon: {phone:0171/234 5678}, Fax: {phone:0171/234 5679}
téléphone {phone:01 42 68 53 00}
Appelez le {phone:+33 1 42 68 53 00} ou le {phone:06-12-34-56-78}.
teléfono {phone:91 234 56 78}
Llame al {phone:+34 912-345-678}.
phone {phone:555-014-7788}
my cell is {phone:415-555-0132} and the office is {phone:+1 415 555 0100}
{phone:+49 89 1234567}
{phone:(0) 89-123 45 67} is the number
Ring {phone:020 7946 0958} and ask for Ann.
mobile: {phone:07700 900123}
Hotline {phone:0800 100 2000}
our number {phone:0131 496 0200} is new
Nummer {phone:0228/555 0199}, Herr Lang
le numéro {phone:05 56 78 90 12} est bon
phones {phone:+1 (303) 555-0111} {card:5500005555555559} on file
contact {phone:+61 2 9374 4000} {ip:203.0.113.9}
{phone:+1 (404) 555-0199} {phone:+1 (404) 555-0188}
{phone:+7 495 123-45-67} {ip:198.51.100.23} ok
paid with {card:4111111111111111}.
Card: {card:4111 1111 1111 1111}, thanks
Karte {card:5500-0055-5555-5559} gültig
carte {card:4012888888881881} refusée
la tarjeta {card:4222.2222.2222.2220} no vale
Visa {card:4012 8888 8888 1881}
cards {card:5105105105105100} {card:4111111111111111} were lost
{card:5105105105105100}
{card:4111-1111-1111-1111}, {phone:+1 212 555 0147}
card no. {card:6011.1111.1111.1117}
the card {card:6011111111111117} and code 123
number {card:5555555555554444} 12 times
24 {card:5555555555554444} of them
Host {ip:192.0.2.44} answered in 12 ms.
from {ip:198.51.100.7} to {ip:203.0.113.250}
ping {ip:10.0.0.1}
server at {ip:172.16.254.3}:8080 is down
IP: {ip:192 . 0 . 2 . 1}
Adresse {ip:203.0.113.77}, Port 443
desde {ip:192.0.2.200} y nada
{ip:10.20.30.40} {ip:10.20.30.41} are up
{ip:192.168.1.1}/24
login by {ip:203. 0. 113. 5} failed
Version 2.0.1 was released in 2021.
Licensed under version 3.0, see section 4.2.1.
GPL 3.
On 12.05.2019 at 14:30 we met.
Le 03/04/2020, 25 personnes.
Am 1.1.2000 um 9 Uhr
born 1984-11-30
It costs 12,50 or 1.299,00 in all.
between 1990 and 2005, 15 of 20
pages 12-18, 20-24 and 112
Order 1234567 has 3 items.
invoice 2020-00017 of 12.03.2020
part no. 12-345-678 in box 9
ISBN 978-3-16-148410-0
token = "f3a1c2d4e5b60718293a4b5c6d7e8f9012345678" here
sha 4d967a30111bf29f0eba01c448b375c1629b2fed
key "0123456789abcdef0123456789abcdef01234567"
The sum is 1 000 000 000 units.
3.141592653589793 is close
population 82,903,000 in 2019
room 101, floor 3, building 12
score 3-2 and 10-12 and 4:1
coordinates 52.5200 13.4050 100 20
rows 1 2 3 4 5 6 7 8 9 10 11 12
matrix 10 20 30 40 50 60 70 80
id 20231231235959 seen
account 12345678901234567890 closed
+ 5 points, + 12 more
a + b = 10, 5 @ 3 dollars each
@home #12 @2pm
100% of 50 @ 12.50 each
call 3 people in 2 hours
phone model 12 pro, 256 gb
the card has 16 digits and 3 more
address 12 main street, 90210
chapter 1.2.3 of the handbook
table 300.400.500.600 wide
Und 12 von 24 sind da, 2. und 3. auch.
En 1999, les 12 mois de 2000.
El 15 de mayo de 2012 a las 10:45.
line 10: x = 4 * (2 + 3) - 1
"""


def labelled_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Text and spans (kind, first, end) of each sentence."""
    return [parsed(line) for line in TABLE.strip().split("\n")]


def parsed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", line):
        if part[:1] == "{":
            kind, value = part[1:-1].split(":", 1)
            spans.append((kind, len(text), len(text) + len(value)))
            part = value
        text += part
    return text, spans
